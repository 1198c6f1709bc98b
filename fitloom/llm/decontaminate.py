"""Operator 8 [native]: benchmark decontamination by SimHash of item-sized windows.

For each benchmark item of m words the windows of m words of every document are looked at. A document is contaminated by an item
if the weighted Jaccard similarity of their five-word shingles (shingles counted as often as they occur) is at least 0.8 for some
window. A document of fewer than m words is one window.

1. Seeds. Window and item have equally many shingles, so at 0.8 they share at least eight ninths of them, and of any ninth of an
   item's shingles plus one at least one is shared. Each item gives its rarest ones (over the whole benchmark) as seeds; where one
   stands in a document, each window of m words around it is a candidate for that item. A shorter document may lack a fifth of an
   item's shingles, so there the rarest fifth plus one are seeds.
2. SimHash. Candidate windows get a 64-bit fingerprint of their shingles, from sums of single bits.
3. Multi-index Hamming blocks. A fingerprint within ``radius`` bits of an item's has at least one of radius + 1 blocks equal to the
   item's; windows meet their items by an equi-join on (item, block, value), then by their whole Hamming distance.
4. The exact similarity is computed for the pairs that are left.

At a similarity of 0.8 a bit differs with a chance of 0.152 (the angle of vectors that share eight ninths), so of 64 bits more than
``RADIUS`` = 28 do in fewer than one of 10**8 pairs, and in fewer the more alike they are. That is the only place where a pair could
go; what the radius keeps is decided by step 4 alone.

Work is that of the candidate windows, m windows of m shingles a seed that is found, which suits items of up to some thousand words.
Words are runs without white space, in lower case. Null texts, and texts or items of fewer than five words, have no shingles and
match nothing. Rows alike in id and text are one document. Null ids match like others, of documents and of items. Extra
columns are carried along by ``decontaminate``, whatever their names. A long text moves once an item that it may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import fresh, let, quoted, text_key, words, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 28
#: The part of its shingles that an item may lack at most in a window as similar as ``SIMILARITY``: one in nine, and one in five of a
#: document that is shorter than the item and has no others. Integers, as 1 - 2 * 0.8 / 1.8 is less than a ninth in floating point.
LACKS, LACKS_SHORT = 9, 5
#: Seeds, and leaks, are broadcast only up to this many rows; beyond, the join shuffles.
MOST_BROADCAST = 200_000


def low_words(text: Column) -> Column:
    return words(F.lower(F.coalesce(text, F.lit(""))))


def shingles(w: Column) -> Column:
    """XXH64 of each run of five words, in order."""
    one = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), one)).otherwise(F.array().cast("array<bigint>"))


def blocks() -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks of nearly equal width."""
    n = RADIUS + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bit_sums(h: Column) -> list[Column]:
    """Counts of single bits, two to a long: 31 bits each."""
    bit = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(1))
    return [F.sum(bit(b) + F.shiftleft(bit(b + 32), 32)).alias(f"s{b}") for b in range(32)]


def from_sums() -> Column:
    """The fingerprint: bits set in over half the shingles."""
    total = F.lit(0).cast("long")
    for b in range(32):
        for at, count in ((b, F.col(f"s{b}").bitwiseAND(F.lit((1 << 32) - 1))), (b + 32, F.shiftrightunsigned(F.col(f"s{b}"), 32))):
            total = total.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return total.alias("fp")


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, sh): the fingerprint ``fp`` and count ``n`` of each."""
    each = rows.select(*keys, F.explode("sh").alias("h"))
    return each.groupBy(*keys).agg(F.count("*").alias("n"), *bit_sums(F.col("h"))).select(*keys, "n", from_sums())


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays: shingles in common over all, each as often as it occurs."""

    def times(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda v: v == h))

    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.array_intersect(a, b)
    common = F.when(once, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))
    return let(common, lambda both: both / (F.size(a) + F.size(b) - both))


def seeds_of(bench: DataFrame) -> DataFrame:
    """(h, items): the seed shingles of ``bench`` (item, m, sh), each with the items (item, m, short) that it stands for.

    An item's rarest shingles until their occurrences are more than it may lack; ``short`` ones count in shorter documents only.
    """
    places = bench.select("item", "m", F.size("sh").alias("size"), F.explode("sh").alias("h"))
    counts = places.groupBy("item", "m", "size", "h").agg(F.count("*").alias("c"))
    everywhere = counts.groupBy("h").agg(F.sum("c").alias("seen"))
    ranked = counts.join(everywhere, "h").groupBy("item", "m", "size").agg(F.sort_array(F.collect_list(F.struct("seen", "h", "c"))).alias("all"))
    before = F.transform("all", lambda x, i: F.struct(x["h"].alias("h"), F.aggregate(F.slice("all", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("before")))
    chosen = ranked.select("item", "m", "size", F.explode(F.filter(before, lambda x: LACKS_SHORT * x["before"] <= F.col("size"))).alias("s"))
    short = LACKS * F.col("s.before") > F.col("size")
    return chosen.select("s.h", F.struct("item", "m", short.alias("short")).alias("x")).groupBy("h").agg(F.collect_list("x").alias("items"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, key, item_id, similarity): each document with each item that is in it, at its best window."""
    cut_up = items.select("item_id", low_words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("m"), shingles(F.col("w")).alias("sh")).filter("size(sh) > 0")
    # An item is known by its id and its shingles, as texts may share an id.
    bench = written(cut_up.withColumn("item", F.xxhash64("item_id", "sh")).dropDuplicates(["item"]), "bench")
    seeds = written(seeds_of(bench), "seeds")
    hashed = docs.select("id", "key", let(low_words(F.col("text")), shingles).alias("sh"))
    positions = hashed.select("id", "key", (F.size("sh") + (SHINGLE - 1)).alias("n"), F.posexplode("sh").alias("p", "h"))
    small = seeds.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hits = positions.join(F.broadcast(seeds) if small else seeds, "h")
    # One row a document and item: where the item's seeds stand.
    for_item = hits.select("id", "key", "n", "p", F.inline("items")).filter(~F.col("short") | (F.col("n") < F.col("m")))
    starts = written(for_item.groupBy(F.col("id").alias("id2"), F.col("key").alias("key2"), "item", "m").agg(F.collect_set("p").alias("hits")), "hits")
    # Few rows beside the texts, which stream past them as they are; only those with a hit are split again.
    near = docs.join(starts.hint("shuffle_hash"), docs["id"].eqNullSafe(F.col("id2")) & (docs["key"] == F.col("key2")))

    def windows(w: Column) -> Column:
        """The starts of the candidates."""

        def around(p: Column) -> Column:
            first, last = F.greatest(F.lit(0), p + SHINGLE - F.col("m")), F.least(p, F.greatest(F.lit(0), F.size(w) - F.col("m")))
            return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.flatten(F.transform("hits", around)))

    found = near.select("id", "key", "item", "m", let(low_words(F.col("text")), lambda w: F.struct(windows(w).alias("at"), shingles(w).alias("sh"))).alias("x"))
    at = found.select("id", "key", "item", "m", "x.sh", F.explode("x.at").alias("start"))
    cut = written(at.select("id", "key", "item", "start", F.slice("sh", F.col("start") + 1, F.col("m") - (SHINGLE - 1)).alias("sh")), "windows")

    place = ["id", "key", "item", "start"]
    by_block = lambda fp: F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (at, width) in enumerate(blocks())))
    windows_ = fingerprints(cut, place).select(*place, "fp", F.explode(by_block(F.col("fp"))).alias("b"))
    index = fingerprints(bench, ["item"]).select("item", F.col("fp").alias("item_fp"), F.explode(by_block(F.col("fp"))).alias("b"))
    met = windows_.join(index, ["item", "b"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*(F.col(c).alias(f"{c}_") for c in place)).distinct()
    same = F.col("id").eqNullSafe(F.col("id_"))
    for c in place[1:]:
        same = same & (F.col(c) == F.col(f"{c}_"))
    pairs = cut.join(met, same, "left_semi").join(bench.select("item", "item_id", F.col("sh").alias("item_sh")), "item")
    return pairs.select("id", "key", "item_id", similarity(F.col("sh"), F.col("item_sh")).alias("similarity")).filter(F.col("similarity") >= SIMILARITY).groupBy("id", "key", "item_id").agg(F.max("similarity").alias("similarity"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(quoted(doc_id)).alias("id"), text_key(F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("text"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    key, leak_id, leak_key = (fresh(docs, n) for n in ("leak_key_", "leak_id_", "leak_doc_key_"))
    rows = docs.withColumn(key, text_key(F.col(quoted(text))))
    leaks = written(contaminated(keyed(docs, doc_id, text), items).select(F.col("id").alias(leak_id), F.col("key").alias(leak_key)).distinct(), "leaks")
    # Up to a checked number of rows the texts need not move again; beyond it they stream past the hashed leaks.
    few = leaks.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(leaks) if few else leaks.hint("shuffle_hash"), F.col(quoted(doc_id)).eqNullSafe(F.col(leak_id)) & (F.col(key) == F.col(leak_key)), "left_anti").select(*map(quoted, docs.columns))


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns: doc_id, item_id, similarity."""
    return contaminated(keyed(docs, "doc_id", "text"), items).select(F.col("id").alias("doc_id"), "item_id", "similarity")


#: Brute force in DuckDB's SQL: every window around every shared shingle.
SQL = r"""
with d as (select distinct doc_id, coalesce(text, '') as t from documents),
dw as (select doc_id, t, list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
ds as (select doc_id, t, len(w) as n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g from (select *, unnest(range(1, greatest(len(w) - 3, 1))) as i from dw)),
iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
it as (select item_id, len(w) as m, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g from (select *, unnest(range(1, greatest(len(w) - 3, 1))) as i from iw)),
ic as (select item_id, m, g, count(*) as c from it group by all),
hits as (select distinct doc_id, t, n, item_id, m, unnest(range(greatest(1, i + 5 - m), least(i, greatest(1, n - m + 1)) + 1)) as s from ds join ic on ds.g = ic.g),
win as (select h.doc_id, h.t, h.n, h.item_id, h.m, h.s, ds.g, count(*) as c from hits h join ds on ds.doc_id is not distinct from h.doc_id and ds.t = h.t and ds.i between h.s and h.s + h.m - 5 group by all),
shared as (select win.doc_id, win.t, win.m - 4 + least(win.m, win.n) - 4 as u, win.item_id, win.m, win.s, sum(least(win.c, ic.c))::BIGINT as b from win join ic on ic.item_id = win.item_id and ic.g = win.g group by all)
select doc_id, item_id, max(b::DOUBLE / (u - b)) as similarity from shared where b::DOUBLE / (u - b) >= 0.8 group by doc_id, t, item_id"""
