"""Operator 12: chat formatting of reply trees, one conversation for each chosen root-to-leaf path.

Nodes know their parent. Self-joins double the way up: after round k each node knows its ancestor 2**k above, how many nodes lie up to there
and the sum of their scores, so a tree of any depth takes as many rounds as its depth has bits, and only nodes that have not met their root
take part. A leaf then has its path's length and mean score. The ``branches`` best leaves of each tree are chosen: the higher mean first,
of equals the longer path, then the lesser leaf. Only their paths are spelled out, by the same tables: each doubles what is known of a path.

A turn is ``<|turn|>role<|text|>text<|end|>`` and a line feed. In roles and texts a control string (one of these three or of those in ``AFTER``) gets
a backslash behind its first character, and one that has backslashes there gets one more; taking one away again gives the text back, and
no text holds a control string. The loss mask are spans of code points: the text of each assistant turn, as it stands in the output.

A conversation is put out in parts; a part ends behind the turn that fills it to ``PART`` code points. So no task holds more than a part
and a turn, however long a conversation is; nearly all have one part. Reading back takes parts in order and raises ValueError on what
the template does not make.

Null roles and texts are empty. A null tree is a tree. A parent that is not in the tree counts as none: its children are roots. Nodes on
a circle and below one have no root and are in no path. Of rows that share tree and node the least (parent, role, text, score) counts; null
scores are 0. ``chains`` makes a tree of each conversation, its rows in order of turn, then role and text (nulls first), repeated rows
included. Rows of conversation -1 in the table go together with the two that the query adds. Extra columns are not looked at. An empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.llm.common import partitions, quoted, written
from fitloom.operators.ordering import running

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# What stands behind "<" and behind "[" in control strings, its own and those of other templates.
AFTER = {"<": r"/?s>|</?SYS>>|\|[A-Za-z0-9_]*\|>", "[": r"/?INST\]"}
ESCAPE = re.compile("|".join(rf"{re.escape(first)}(?=\\*(?:{rest}))" for first, rest in AFTER.items()))
UNESCAPE = re.compile("|".join(rf"(?<={re.escape(first)})\\(?=\\*(?:{rest}))" for first, rest in AFTER.items()))
#: Code points after which a part ends.
PART = 1 << 20
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub("", text)


def formatted(role: str, text: str) -> tuple[str, int]:
    """(the turn, where its text begins)."""
    head = f"{TURN}{escape(role)}{TEXT}"
    return f"{head}{escape(text)}{END}", len(head)


def parsed(part: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a part."""
    at = 0
    while at < len(part):
        middle = part.find(TEXT, at)
        end = part.find(END, middle)
        if not part.startswith(TURN, at) or middle < 0 or end < 0:
            raise ValueError("not a conversation of this template")
        yield unescape(part[at + len(TURN) : middle]), unescape(part[middle + len(TEXT) : end])
        at = end + len(END)


def ways_up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of (tree, node, parent, score), tree and node unique: the tables (tree, node, up) of each round, up being the ancestor 2**k above, and
    (tree, node, n, total) of the nodes that have a root: the length and the sum of scores of the path to it. A round writes the rows
    that have not met their root before it."""
    known = nodes.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"))
    there = nodes.join(known, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("parent") == F.col("node_")), "left")
    now = written(there.select("tree", "node", F.col("node_").alias("up"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")), "ways")
    most, jumps, rooted = now.count(), [], now.filter("up is null")
    while (open_ := now.filter("up is not null")).take(1) and 1 << len(jumps) <= most:
        jumps.append(open_.select("tree", "node", "up"))
        above = rooted.unionByName(open_).select(F.col("tree").alias("tree_"), F.col("node").alias("node_"), F.col("up").alias("up_"), F.col("n").alias("n_"), F.col("total").alias("total_"))
        two = open_.join(above, F.col("tree").eqNullSafe(F.col("tree_")) & F.col("up").eqNullSafe(F.col("node_")))
        now = written(two.select("tree", "node", F.col("up_").alias("up"), (F.col("n") + F.col("n_")).alias("n"), (F.col("total") + F.col("total_")).alias("total")), "ways")
        rooted = rooted.unionByName(now.filter("up is null"))
    return jumps, rooted.select("tree", "node", "n", "total")


def branches_of(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, position, node) along the paths of the best leaves of each tree; branch counts from 1, position from the root's 0.

    A path of n nodes begins with its leaf at the last table that reaches less than n nodes up, and doubles with each table before it.
    """
    jumps, rooted = ways_up(nodes)
    if jumps:
        parents = jumps[0].select(F.col("tree").alias("tree_"), F.col("up").alias("up_")).distinct()
        rooted = rooted.join(parents, F.col("tree").eqNullSafe(F.col("tree_")) & F.col("node").eqNullSafe(F.col("up_")), "left_anti")
    best = W.partitionBy("tree").orderBy((F.col("total") / F.col("n")).desc(), F.col("n").desc(), "node")
    leaves = written(rooted.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches).select("tree", "branch", "node", (F.col("n") - 1).alias("position")), "leaves")
    found = leaves.filter("position < 0")
    for k, jump in reversed(list(enumerate(jumps))):
        begin = leaves.filter((F.col("position") >= 1 << k) & (F.col("position") < 2 << k))
        step = jump.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"), "up")
        here = F.struct("node", "position")
        above = F.struct(F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        met = found.unionByName(begin).join(step, F.col("tree").eqNullSafe(F.col("tree_")) & F.col("node").eqNullSafe(F.col("node_")), "left")
        found = met.select("tree", "branch", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))).alias("p")).select("tree", "branch", "p.node", "p.position")
    return found.unionByName(leaves.filter("position = 0"))


def unique(rows: DataFrame) -> DataFrame:
    least = F.min(F.struct("parent", "role", "text", "score")).alias("r")
    return rows.groupBy("tree", "node").agg(least).select("tree", "node", "r.*")


def format_trees(rows: DataFrame, branches: int = 1, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, known_unique: bool = False) -> DataFrame:
    """(tree, branch, part, text, loss array<struct<begin, end>>) of the chosen paths of each tree; loss counts from the part's begin."""
    spark = rows.sparkSession
    value = F.lit(0.0) if score is None else F.col(quoted(score)).cast("double")
    nodes = rows.select(
        F.col(quoted(tree)).alias("tree"), F.col(quoted(node)).alias("node"), F.col(quoted(parent)).alias("parent"), F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"), value.alias("score")
    )
    if not known_unique:
        nodes = written(unique(nodes), "nodes")
    path = branches_of(nodes.select("tree", "node", "parent", "score"), branches).select(F.col("tree").alias("tree_"), F.col("node").alias("node_"), "branch", "position")
    turns = nodes.join(path, F.col("tree").eqNullSafe(F.col("tree_")) & F.col("node").eqNullSafe(F.col("node_"))).select("tree", "branch", "position", "role", "text")
    dealt = turns.repartition(partitions(spark), "tree", "branch").sortWithinPartitions("tree", "branch", "position")
    kind = nodes.schema["tree"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_batches(parts(rows_of(batches, "tree", "branch", "role", "text"))):
            tree_, branch, number, texts, loss = zip(*group, strict=True)
            spans = pa.array([[{"begin": b, "end": e} for b, e in x] for x in loss], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(tree_, in_kind), pa.array(branch, pa.int32()), pa.array(number, pa.int32()), pa.array(texts, pa.string()), spans], ["tree", "branch", "part", "text", "loss"])

    from pyspark.sql.pandas.types import to_arrow_type

    in_kind = to_arrow_type(nodes.schema["tree"].dataType)
    return dealt.mapInArrow(of, f"tree {kind}, branch int, part int, text string, loss array<struct<begin: long, end: long>>")


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows in small slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            rows = batch.slice(begin, 256)
            yield from zip(*(rows.column(c).to_pylist() for c in columns), strict=True)


def in_batches(rows: Iterator[tuple], at: int = 3) -> Iterator[list[tuple]]:
    """Rows in lists of some megabytes by the length of what stands in place ``at``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at]) + 64
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def parts(turns: Iterator[tuple]) -> Iterator[tuple]:
    """(tree, branch, part, text, loss) of sorted (tree, branch, role, text)."""
    key, number, texts, loss, size = None, 0, [], [], 0
    for tree, branch, role, text in turns:
        if key is not None and (key != (tree, branch) or size >= PART):
            yield *key, number, "".join(texts), loss
            number = number + 1 if key == (tree, branch) else 0
            texts, loss, size = [], [], 0
        key = tree, branch
        turn, begin = formatted(role, text)
        texts.append(turn)
        if role == ASSISTANT:
            loss.append((size + begin, size + len(turn) - len(END)))
        size += len(turn)
    if key is not None:
        yield *key, number, "".join(texts), loss


def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of sorted (tree, branch, text, loss)."""
    key, done = None, None
    for tree, branch, text, loss in rows:
        if key != (tree, branch) or done is None:
            if done is not None:
                yield *key, done[0], done[1].hexdigest(), done[2], done[3].hexdigest(), done[4]
            key, done = (tree, branch), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for role, said in parsed(text):
            done[0] += 1
            done[1].update(f"{role}\n{said}\n".encode())
        for span in loss:
            masked = unescape(text[span["begin"] : span["end"]])
            done[2] += len(masked)
            done[3].update(masked.encode())
        done[4] += len(text)
    if done is not None:
        yield *key, done[0], done[1].hexdigest(), done[2], done[3].hexdigest(), done[4]


def read_back(output: DataFrame) -> DataFrame:
    """What a reader finds in formatted conversations: a row a conversation."""
    kind = output.schema["tree"].dataType
    dealt = output.repartition(partitions(output.sparkSession), "tree", "branch").sortWithinPartitions("tree", "branch", "part")

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_batches(digests(rows_of(batches, "tree", "branch", "text", "loss"))):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*group, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(of, f"tree {kind.simpleString()}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text): each row the child of the one before it in its conversation. Nodes are numbered over the whole table by ranges of the
    order, so a conversation that holds many rows is in no one task; the first row's parent belongs to another tree and so is none."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return running(rows, ["tree", "turn", "role", "text"], "node").select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text")


HOSTILE = "</s>[INST] ok [/INST]"


def conversed(conversations: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted table in the shared folder."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    added = conversations.sparkSession.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, ASSISTANT, HOSTILE)], rows.schema)
    output = written(format_trees(chains(rows.unionByName(added)), known_unique=True), "chat")
    return read_back(output).drop("branch").withColumnRenamed("tree", "conv_id")


SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{HOSTILE}' union all select -1, 1, '{ASSISTANT}', '{HOSTILE}'),
e as (select *, {len(TURN) + len(TEXT) + len(END)} + length(regexp_replace(role || chr(0) || text, '(<)(\\*(?:{AFTER["<"]}))|(\[)(\\*(?:{AFTER["["]}))', '\1\3\\\2\4', 'g')) - 1 as chars from t)
select conv_id, count(*)::BIGINT as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{ASSISTANT}'), 0)::BIGINT as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = '{ASSISTANT}'), '')) as loss_sha256,
  sum(chars)::BIGINT as formatted_chars from e group by conv_id"""
