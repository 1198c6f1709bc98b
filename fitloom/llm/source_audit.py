"""Operator 13: how the vocabulary of each source diverges from that of the other sources and of its language.

Tasks count the terms of their documents (a term's occurrences and documents) and put out one row a term, source and task; the sums are
aggregates by (lang, source, term) first and by (lang, term) then, so a common term is in one task with a row a source only. A term's column
is its sparse vector (source, count). Terms with one vector are alike in all that follows: vectors are counted, and each pair of
sources is worked out once for each distinct vector and multiplied by the number of its terms. Where both counts are 0 the value depends on the
two sources alone; that is added once for all V terms, and a vector adds, for each of its sources, what differs from it. For the ranks of terms
each vector gets its value for each of its sources; only vectors that fewer than ``TOP`` vectors exceed are joined back to their terms.

All arithmetic is in integers: 10**9 * (count + 1) // (N + V) by long division in three digits of a thousand, so counts up to 9 * 10**15 are safe.

Null text, lang and source are empty. Each row is a document, rows that share an id, too. Rows of (lang, source) without a term, or of a language
without a kept term, give pairs of value 0 or of the counts 0. A text of any length is counted in pieces. An empty table gives an empty one.
Extra columns are not looked at. One row holds the sources of a language, and a task a row and a column of the matrix of pairs for each source that
its vectors name, which it puts out when they fill ``CELLS`` cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.llm.common import written

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
#: Terms that a task counts before it puts them out.
COUNTED = 400_000
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20
#: Cells of pair sums that a task holds, and of counts that it works on at once.
CELLS, AT_ONCE = 8_000_000, 1 << 19
#: Groups up to which the table of groups is broadcast; beyond, joins shuffle.
MOST_GROUPS = 200_000
#: Each byte as it stands in a term; a blank for those that stand in none.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in some lists."""
    data = text.translate(LETTERS)
    begin = 0
    while begin < len(data):
        end = begin + PIECE
        if end < len(data):
            cut = data.rfind(b" ", begin, end)
            end = cut if cut > begin else data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, a row a task or more."""

    def put(tables: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in tables.items():
            terms, counts = list(n), list(n.values())
            for begin in range(0, len(terms), 65536):
                some = terms[begin : begin + 65536]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string(), safe=False), pa.array(counts[begin : begin + 65536], pa.int64()), pa.array([d[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "d"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                for lang, source, text in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    n, d = tables.setdefault((lang, source), (Counter(), Counter()))
                    before, seen = len(n), set()
                    for terms in terms_of(text):
                        n.update(terms)
                        seen.update(terms)
                    d.update(seen)
                    held += len(n) - before
                    if held >= COUNTED:
                        yield from put(tables)
                        tables, held = {}, 0
        yield from put(tables)

    return docs.mapInArrow(of, "lang string, source string, term string, n long, d long")


def shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + 10**9 * (counts + 1) // of, by long division; counts + 1 <= of."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, of).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


class PairSums:
    """Sums over vectors of what pairs of a language's sources differ from the value of two counts of 0."""

    def __init__(self, names: list[str], sums: list[int], v: int):
        self.names, self.of = names, np.array(sums, np.int64) + v
        self.zero = shares(np.zeros(len(names), np.int64), self.of)
        self.rows: dict[int, np.ndarray] = {}
        self.columns: dict[int, np.ndarray] = {}

    def add(self, counts: np.ndarray, times: np.ndarray) -> None:
        """``counts``: a row a vector, a column a source. ``times``: the terms of each vector."""
        p = shares(counts, self.of[None, :])
        for g in np.flatnonzero(counts.any(axis=0)).tolist():
            at = np.flatnonzero(counts[:, g])
            q, own, m = p[at], p[at, g][:, None], times[at][:, None]
            row = ((gain(own, q) - gain(self.zero[g], self.zero)) * m).sum(axis=0)
            column = ((gain(q, own) - gain(self.zero, self.zero[g])) * m * (counts[at] == 0)).sum(axis=0)
            self.rows[g] = self.rows[g] + row if g in self.rows else row
            self.columns[g] = self.columns[g] + column if g in self.columns else column

    def cells(self) -> int:
        return (len(self.rows) + len(self.columns)) * len(self.names)

    def take(self) -> Iterator[tuple[str, str, int]]:
        """(source, other, sum) of all pairs that differ; the sums begin anew."""
        names = self.names
        for g, values in self.rows.items():
            for h in np.flatnonzero(values).tolist():
                if h != g:
                    yield names[g], names[h], int(values[h])
        for g, values in self.columns.items():
            for h in np.flatnonzero(values).tolist():
                yield names[h], names[g], int(values[h])
        self.rows, self.columns = {}, {}


def pair_sums(vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value) of (lang, counts, m, names, sums, v), to be summed up."""

    def put(lang: str, sums: PairSums) -> Iterator[pa.RecordBatch]:
        rows = list(sums.take())
        for begin in range(0, len(rows), 65536):
            source, item, value = zip(*rows[begin : begin + 65536], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(source)), pa.array(source), pa.array(item), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, PairSums] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = batch.filter(pc.equal(langs.indices, code))
                if lang not in known:
                    known[lang] = PairSums(rows.column("names")[0].as_py(), rows.column("sums")[0].as_py(), rows.column("v")[0].as_py())
                sums = known[lang]
                step = max(1, AT_ONCE // len(sums.names))
                for begin in range(0, rows.num_rows, step):
                    part = rows.slice(begin, step)
                    vectors = part.column("counts")
                    flat = vectors.flatten()
                    at = pc.index_in(flat.field("source"), value_set=pa.array(sums.names)).to_numpy()
                    counts = np.zeros((part.num_rows, len(sums.names)), np.int64)
                    counts[np.repeat(np.arange(part.num_rows), pc.list_value_length(vectors).to_numpy()), at] = flat.field("n").to_numpy()
                    sums.add(counts, part.column("m").to_numpy())
                    if sum(s.cells() for s in known.values()) >= CELLS:
                        for name, full in known.items():
                            yield from put(name, full)
        for name, sums in known.items():
            yield from put(name, sums)

    return vectors.mapInArrow(of, "lang string, source string, item string, value long")


def share(count: Column, of: Column) -> Column:
    """As ``shares``."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + whole(rest * 1000, of), (rest * 1000) % of
    return out + 1


def whole(a: Column, b: Column) -> Column:
    """The quotient of two longs without its remainder."""
    return F.call_function("div", a, b)


def audited(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    by_source = term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(by_term.filter(F.col("d") >= LEAST_DOCUMENTS).select("lang", "term", F.sort_array("counts").alias("counts")), "terms")
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("sum"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(size, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("sum", F.lit(0)).cast("long").alias("sum"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "groups")
    few = F.broadcast if groups.count() <= MOST_GROUPS else lambda df: df
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "sum"))).alias("s"), F.first("v").alias("v"), F.sum("sum").alias("all"))
    langs = written(langs.select("lang", "v", "all", F.col("s.source").alias("names"), F.col("s.sum").alias("sums")), "langs")
    vectors = written(kept.groupBy("lang", "counts").agg(F.count("*").alias("m")), "vectors")
    return pairs(groups, few(langs), vectors).unionByName(terms(kept, few(groups), few(langs), vectors))


def pairs(groups: DataFrame, langs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The part ``pair``: a row for each two sources of a language."""
    found = pair_sums(vectors.join(langs.drop("all"), "lang")).groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    other = langs.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("o")).select("lang", F.col("o.names").alias("item"), F.col("o.sums").alias("item_sum"))
    every = groups.join(other, "lang").filter("source <> item")
    of = lambda total: F.greatest(F.col(total) + F.col("v"), F.lit(1))  # noqa: E731  without a kept term there is nothing to divide by
    zero = every.withColumn("p", share(F.lit(0).cast("long"), of("sum"))).withColumn("q", share(F.lit(0).cast("long"), of("item_sum")))
    gap = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    base = zero.withColumn("base", F.col("v") * whole(gap, F.col("q")))
    valued = base.join(found, ["lang", "source", "item"], "left").withColumn("value", F.when(F.col("v") > 0, F.col("base") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return ranked(valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The part ``term``: the ``TOP`` terms of each source that it has more of than its language."""
    in_all = vectors.select("lang", "counts", F.aggregate("counts.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_all"), F.explode("counts").alias("c"))
    known = in_all.join(langs.select("lang", "all"), "lang").join(groups, F.struct(in_all["lang"], F.col("c.source")) == F.struct(groups["lang"], groups["source"])).select(in_all["lang"], "source", "counts", "c.n", "n_all", "all", "sum", "v")
    valued = known.withColumn("p", share(F.col("n"), F.col("sum") + F.col("v"))).withColumn("q", share(F.col("n_all"), F.col("all") + F.col("v"))).filter("p > q")
    gap = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    worth = valued.select("lang", "source", "counts", whole(gap, F.col("q")).alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc())
    first = written(worth.withColumn("r", F.rank().over(best)).filter(F.col("r") <= TOP).drop("r"), "best")
    found = kept.join(first, ["lang", "counts"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return ranked(found).filter(F.col("rank") <= TOP)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


SQL = rf"""
with d as materialized (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as materialized (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from w group by all),
k as materialized (select lang, term from w group by all having count(distinct r) >= {LEAST_DOCUMENTS}),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
x as materialized (select lang, source, term, coalesce(n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
p as materialized (select lang, source, term, x.n, 1 + ({UNIT}::HUGEINT * (x.n + 1)) // (s.n + v) as p from x join (select lang, source, sum(n) as n from x group by all) s using (lang, source) join v using (lang)),
l as (select lang, term, sum(n) as n from x group by all),
q as (select lang, term, 1 + ({UNIT}::HUGEINT * (l.n + 1)) // (s.n + v) as q from l join (select lang, sum(n) as n from l group by lang) s using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value::BIGINT as value, (row_number() over (partition by lang, source, part order by value desc, item))::INTEGER as rank from o qualify part = 'pair' or rank <= {TOP}"""
