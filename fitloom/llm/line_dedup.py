"""Operator 6 [native]: repeated passages by overlapping windows of three lines.

Lines without a word are left where they are and are no part of a window. Each three consecutive worded lines, trimmed, give a
128-bit hash; of windows alike everywhere, the first in order of (doc_id, position) stays and the lines of all others go; lines
that several windows cover go once.

Null text and texts of fewer than three worded lines have no window and stay. Rows alike in id and text are one document and get
the same result. A null id comes last in the order; of different texts that share an id the one with the smaller 64-bit hash comes
first. Extra columns are carried along, whatever their names. A text of any length is cut in one pass over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import WORD, fresh, let, quoted, text_key, written

WINDOW = 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def worded(lines: Column) -> Column:
    """Positions of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())


def windows(docs: DataFrame) -> DataFrame:
    """(id, key, pos, h1, h2) of each window; ``pos`` counts worded lines."""

    def of(lines: Column) -> Column:
        n = F.size(lines) - (WINDOW - 1)
        one = lambda i: F.struct(i.alias("pos"), *(F.xxhash64(F.lit(seed), *(F.get(lines, i + k) for k in range(WINDOW))).alias(f"h{seed}") for seed in (1, 2)))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))

    lines = F.filter(F.transform(split_lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))), lambda x: x != "")
    return docs.select("id", "key", F.explode(let(lines, of)).alias("w")).select("id", "key", "w.pos", "w.h1", "w.h2")


def later_windows(docs: DataFrame) -> DataFrame:
    """(id, key, found): the positions of windows that stand earlier elsewhere. One row a document that has any."""
    every = windows(docs)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "pos")
    first = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    # A table of its own: the join reads two plain exchanges, and the places of a very common window can be split.
    repeated = every.join(written(first, "windows"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return repeated.groupBy("id", "key").agg(F.collect_set("pos").alias("found"))


def kept_lines(lines: Column, found: Column) -> Column:
    """The lines that no window of ``found`` covers; each step is linear in the lines."""

    def cut(w: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform(found, lambda p: F.transform(F.sequence(p, p + (WINDOW - 1)), lambda j: F.get(w, j)))))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda i: F.get(lines, i))

    return F.when(found.isNull(), lines).otherwise(let(worded(lines), cut))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the new columns ``kept_text_`` (null where the text is null), ``n_lines_`` and ``n_removed_``; each name is made longer
    while ``docs`` has it. The last three columns of the result are these, in this order."""
    inner = lambda name: fresh(docs, name)
    key, found_id, found_key, found_pos, cut = (inner(n) for n in ("line_key_", "found_id_", "found_key_", "found_pos_", "line_kept_"))
    source = F.col(quoted(text))
    rows = docs.withColumn(key, text_key(source))
    found = later_windows(rows.select(F.col(quoted(doc_id)).alias("id"), F.col(key).alias("key"), source.alias("text")))
    found = found.select(F.col("id").alias(found_id), F.col("key").alias(found_key), F.col("found").alias(found_pos))
    # The positions are hashed and the texts stream past them: no text is sorted.
    joined = rows.join(found.hint("shuffle_hash"), F.col(quoted(doc_id)).eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(found_key)), "left")
    kept = let(split_lines(source), lambda lines: let(kept_lines(lines, F.col(found_pos)), lambda k: F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(k)).alias("r"), F.when(source.isNotNull(), F.array_join(k, "\n")).alias("t"))))
    # The array of one row keeps filters on the result from being pushed below, where lines would be cut again.
    out = joined.select(*map(quoted, docs.columns), F.explode(F.array(kept)).alias(cut))
    return out.select(*map(quoted, docs.columns), F.col(f"{cut}.t").alias(inner("kept_text_")), F.col(f"{cut}.n").cast("bigint").alias(inner("n_lines_")), F.col(f"{cut}.r").cast("bigint").alias(inner("n_removed_")))


def deduped(docs: DataFrame) -> DataFrame:
    """The query's columns; the sha256 is that of the kept text (null: of the empty text)."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.sha2(F.coalesce("kept_text_", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as no from d),
w as (select doc_id, t, no, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
g as (select doc_id, t, no as n1, lead(no, 1) over p as n2, lead(no, 2) over p as n3, line as l1, lead(line, 1) over p as l2, lead(line, 2) over p as l3 from w window p as (partition by doc_id, t order by no)),
r as (select *, row_number() over (partition by l1, l2, l3 order by doc_id nulls last, t, n1) as o from g where n3 is not null),
c as (select distinct doc_id, t, unnest([n1, n2, n3]) as no from r where o > 1)
select l.doc_id, count(*)::BIGINT as n_lines, count(c.no)::BIGINT as n_removed, sha256(coalesce(string_agg(l.line, chr(10) order by l.no) filter (c.no is null), '')) as kept_sha256
from l left join c on c.doc_id is not distinct from l.doc_id and c.t = l.t and c.no = l.no group by l.doc_id, l.t"""
