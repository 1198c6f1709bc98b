"""Operator 3: near-duplicates by SimHash, with pigeonring filtering.

Fingerprints of 64 bits that differ in at most 4 are linked; ``Ring`` finds them.

Only distinct fingerprints are compared, and each group of a key gives at most as many edges as it has members (a forest of what is
linked in it), so large groups of copies stay linear in what is sent on. Components are found by rounds of joins.

A key of the ring has 25 or 26 bits, so n distinct fingerprints meet about n / 2**25 others under each of their 70 keys: 300 at 10**10.
``Ring`` with ``keyed=3`` has keys of 38 or 39 bits at 1,370 keys a fingerprint, for more.

Null text is an empty text: fingerprint zero, linked like any other. Rows with one id each get a row. A null id gets a fingerprint
and the component of the others; a component without any id has a null component_id. Extra columns are not looked at by ``grouped``;
``one_of_each`` carries them along, whatever their names. A long text is one row of one task; its work is linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.llm.common import fresh, partitions, quoted, text_key, written
from fitloom.llm.components import components

#: Groups of a key above this many members are searched along the chain of one segment more, smaller ones pair by pair, all groups of a
#: batch at once. Both find the same links.
LARGE = 128
#: Pairs looked at in one numpy step.
STEP = 1 << 18


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words joined by blanks, A-Z in lower case; of all words if they are fewer; none without words."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    begins = [0, *(e + 1 for e in ends)]
    return [digest(joined[b:e], seed) for b, e in zip(begins, ends[size - 1 :])]


def simhash(hashes: list[int]) -> int:
    if not hashes:
        return 0
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[i : i + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(rows), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``fp``, a signed long with the bits of the fingerprint; ``docs`` has ``text``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((simhash(shingle_hashes(t.as_py() or b"", shingle)) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps)], [*keep, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(of, f"{kinds}, fp long")


class Ring:
    """Pigeonring filtering of 64-bit fingerprints within ``radius``.

    The bits are a ring of segments. Of two fingerprints within the radius, from some segment on every chain of n consecutive segments
    differs in at most floor(radius n / segments) bits. The first ``keyed`` segments of such a chain make an equi-join key, one side
    sending each change that the budgets allow in those behind the first; longer chains prune what meets under a key.
    """

    def __init__(self, radius: int, widths: tuple[int, ...], keyed: int):
        self.radius, self.widths, self.parts, self.keyed = radius, widths, len(widths), keyed
        self.shifts = [sum(widths[:i]) for i in range(self.parts)]
        self.budgets = [radius * (n + 1) // self.parts for n in range(self.parts)]
        if sum(widths) != 64 or self.budgets[0] or not 1 <= keyed < self.parts <= 8:
            raise ValueError("keys need an equal first segment, and at most eight segments")
        self.low = max(sum(widths[(i + k) % self.parts] for k in range(keyed)) for i in range(self.parts))
        self.masks = np.array([[self.mask(i, n + 1) for n in range(self.parts)] for i in range(self.parts)], np.uint64)

    def mask(self, first: int, length: int) -> int:
        return sum(((1 << self.widths[i]) - 1) << self.shifts[i] for i in ((first + k) % self.parts for k in range(length)))

    def segment(self, fps: np.ndarray, i: int) -> np.ndarray:
        return (fps >> np.uint64(self.shifts[i])) & np.uint64((1 << self.widths[i]) - 1)

    def changes(self, first: int) -> list[int]:
        """What may be changed in the key from segment ``first`` on: at most ``budgets[n]`` bits in its first n + 1 segments."""
        out = [(0, 0)]
        for n in range(1, self.keyed):
            width = self.widths[(first + n) % self.parts]
            out = [(x << width | sum(1 << b for b in bits), d + len(bits)) for x, d in out for k in range(self.budgets[n] - d + 1) for bits in combinations(range(width), k)]
        return [x for x, _ in out]

    def keys(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """For each segment the key as it is (True), then those with changes. Keys have ``low`` + 3 bits."""
        for i in range(self.parts):
            key = np.zeros(len(fps), np.uint64)
            for n in range(self.keyed):
                j = (i + n) % self.parts
                key = (key << np.uint64(self.widths[j])) | self.segment(fps, j)
            key |= np.uint64(i << self.low)
            for x in self.changes(i):
                yield key ^ np.uint64(x), x == 0

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The segment that each key begins with."""
        return ((keys >> np.uint64(self.low)) & np.uint64(7)).astype(np.int64)

    def linked(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether the differences ``x`` of pairs that meet under ``keys`` keep to the budgets of all chains from there."""
        first = self.first(keys)
        ok = np.ones(len(x), bool)
        for n, most in enumerate(self.budgets):
            ok &= np.bitwise_count(x & self.masks[first, n]) <= most
        return ok


#: Four bits in five segments; each key has 25 or 26 bits.
WHOLE = Ring(4, (13, 13, 13, 13, 12), 2)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as keep together what the edges (u, v) link: each node with the least of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def search(ring: Ring, first: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of a forest over distinct fingerprints that share a key from segment ``first`` on.

    The chain of one segment more tells which values of the next segment a link can have; members are kept by that value. Each member
    that is reached looks there for those that aren't yet, so a group of near copies is linear.
    """
    n = ring.keyed
    part = ring.segment(fps, (first + n) % ring.parts)
    width = ring.widths[(first + n) % ring.parts]
    changes = [sum(1 << b for b in bits) for k in range(ring.budgets[n] + 1) for bits in combinations(range(width), k)]
    order = np.argsort(part, kind="stable")
    values, begins = np.unique(part[order], return_index=True)
    left = dict(zip(values.tolist(), np.split(order, begins[1:])))
    alive, at_part = np.ones(len(fps), bool), part.tolist()
    us, vs = [order[:0]], [order[:0]]
    for start in range(len(fps)):
        queue = [start] if alive[start] else []
        alive[start] = False
        while queue:
            at = queue.pop()
            for value in (at_part[at] ^ c for c in changes):
                members = left.get(value)
                if members is None:
                    continue
                members = members[alive[members]]
                near = np.bitwise_count(fps[members] ^ fps[at]) <= ring.radius
                found = members[near]
                if len(found):
                    alive[found] = False
                    us.append(np.full(len(found), at))
                    vs.append(found)
                    queue += found.tolist()
                    members = members[~near]
                if len(members):
                    left[value] = members
                else:
                    del left[value]
    return np.concatenate(us), np.concatenate(vs)


def pair_up(ring: Ring, keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes of rows that share a key; ``keys`` is sorted and holds whole groups."""
    if not len(keys):
        return nodes, nodes
    # Rows alike in fingerprint are linked to the first of them, which alone goes on.
    order = np.lexsort((fps, keys))
    keys, fps, nodes, plain = keys[order], fps[order], nodes[order], plain[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])]
    first = np.flatnonzero(new)
    us, vs = [nodes], [nodes[first[np.cumsum(new) - 1]]]
    keys, fps, nodes, plain = keys[first], fps[first], nodes[first], plain[first]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    whole = np.add.reduceat(plain.astype(np.int64), starts)
    for s, n in zip(starts[(whole > 0) & (sizes > LARGE)], sizes[(whole > 0) & (sizes > LARGE)]):
        u, v = search(ring, int(ring.first(keys[s : s + 1])[0]), fps[s : s + n])
        us.append(nodes[s + u])
        vs.append(nodes[s + v])
    use = (whole > 0) & (sizes > 1) & (sizes <= LARGE)
    starts, sizes = starts[use], sizes[use]
    # Each unchanged row against every row of its group.
    group = np.repeat(np.arange(len(starts)), sizes)
    row = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    mine = plain[row]
    left, of = row[mine], group[mine]
    upto = np.cumsum(sizes[of])
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        n = sizes[of[at:end]]
        a = np.repeat(left[at:end], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of[at:end]], n)
        some = (nodes[a] != nodes[b]) & (~plain[b] | (nodes[a] < nodes[b]))
        a, b = a[some], b[some]
        ok = ring.linked(fps[a] ^ fps[b], keys[a])
        us.append(nodes[a[ok]])
        vs.append(nodes[b[ok]])
        at = end
    u, v = np.concatenate(us), np.concatenate(vs)
    some = u != v
    return forest(u[some], v[some]) if some.any() else (u[:0], v[:0])


def links(prints: DataFrame, ring: Ring = WHOLE) -> DataFrame:
    """Edges (u, v) that keep together all linked fingerprints of ``prints`` (fp), which are distinct and are their own nodes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(part, 4096)
                for key, plain in ring.keys(fps.to_numpy().view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), fps, pa.array(np.full(len(fps), plain))], ["k", "fp", "plain"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            k, fp, plain = (np.concatenate([p[i] for p in parts]) for i in range(3))
            u, v = pair_up(ring, k, fp, fp, plain)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            k, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("k", "fp"))
            plain = batch.column("plain").to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            # The last group of a batch may go on in the next one.
            cut = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            if cut:
                yield out([*held, (k[:cut], fp[:cut], plain[:cut])])
                held = []
            elif held and held[-1][0][-1] != k[0]:
                yield out(held)
                held = []
            held.append((k[cut:], fp[cut:], plain[cut:]))
        if held:
            yield out(held)

    rows = prints.select("fp").mapInArrow(spread, "k long, fp long, plain boolean")
    return rows.repartition(partitions(prints.sparkSession), "k").sortWithinPartitions("k").mapInArrow(meet, "u long, v long")


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node."""
    found = components(edges)
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def grouped(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The query's columns: doc_id, fingerprint, component_id."""
    rows = written(fingerprints(docs.select("doc_id", "text"), shingle, ["doc_id"]), "prints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = rooted(distinct.select(F.col("fp").alias("node")), links(distinct))
    # Tables of their own: the joins read two plain exchanges, and the prints of a large component, or copies of one print, can be split.
    of_print = written(distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root"), "roots")
    least = written(of_print.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_print = written(of_print.join(least, "root").select("fp", "component_id"), "by_print")
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies share this part of their shingles at least (Jaccard, as a fraction of integers).
SHARE, OF = 4, 5
#: Sizes of two near copies differ by this factor at most.
SIZE_RATIO = OF / SHARE
#: Texts of up to so many shingles are dealt to classes of so many at most, on the average, and of over half of that.
CLASS_SHINGLES = ((256, 4), (2048, 8), (1 << 62, 16))
#: Bits in which whole fingerprints of near copies differ at most: 4.3 standard deviations beyond what a similarity of 0.8 gives.
SKETCH = 22
#: Members of a group of a class are compared with so many that come behind them: all pairs of up to this many and one.
WINDOW = 32
#: Of these, each member of a larger group sends the nearest, so many.
NEAREST = 2
#: Larger groups are put in order by the whole fingerprints, turned in so many ways.
TURNS = 4
#: All pairs of larger groups are compared by their shingles in tasks that hold two blocks of about so many texts and shingles at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 4096, 1 << 20


def level(n: float) -> int:
    """The logarithm of the number of classes for a text of ``n`` shingles."""
    return max(0, int(np.ceil(np.log2(n / next(k for most, k in CLASS_SHINGLES if n <= most)))))


def class_prints(hashes: list[int]) -> tuple[np.ndarray, int, int]:
    """Keys of the classes of a text's shingles, the fingerprint of the whole, and how many distinct shingles there are.

    Shingles are dealt by their hash to 2**level classes, and a key is made of the class and the fingerprint of its shingles. Two texts
    of n shingles and a similarity of 0.8 or more differ in 2/9 n shingles of both together at most; with classes of 2 to 4 shingles
    these can't touch all, with the larger ones of long texts many stay as they are by chance. A text whose near copy may be large
    enough for another level has that one, too."""
    all_ = np.unique(np.array(hashes, np.uint64))
    n = len(all_)
    if not n:
        return np.zeros(1, np.uint64), 0, 0
    bits = np.unpackbits(all_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view(np.uint64)[0])
    out = []
    for at in {level(n), level(n * SIZE_RATIO)}:
        of = (all_ >> np.uint64(40)) & np.uint64((1 << at) - 1)
        order = np.argsort(of, kind="stable")
        classes, begins, sizes = np.unique(of[order], return_index=True, return_counts=True)
        ones = np.add.reduceat(bits[order], begins, axis=0, dtype=np.int32)
        fps = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        scope = (np.uint64(at << 24) | classes) * np.uint64(0x9E3779B97F4A7C15)
        # One shingle more or less may leave the majorities of a small class as they are; its size tells.
        out.append(fps ^ (scope + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(out), whole, n


def turned(fps: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The whole fingerprints, turned as the key says: classes put their members in one of ``TURNS`` orders."""
    by = keys.view(np.uint64) % np.uint64(TURNS) * np.uint64(64 // TURNS)
    return (fps << by) | (fps >> ((np.uint64(64) - by) & np.uint64(63)))


def near_pairs(keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (u, v), u < v, among rows that share a key; rows of a key stand together, in order of their ``turned`` fingerprints."""
    n = len(keys)
    if not n:
        return nodes, nodes
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    many = np.diff(np.r_[begins, n])
    large = np.repeat(many > WINDOW + 1, many)
    us, vs = [], []
    best, to = np.full((NEAREST, n), 65), np.zeros((NEAREST, n), np.int64)
    for k in range(1, min(WINDOW, n - 1) + 1):
        x = np.flatnonzero(keys[:-k] == keys[k:])
        if not len(x):
            break
        y = x + k
        d = np.bitwise_count(fps[x] ^ fps[y]).astype(np.int64)
        ok = (d <= SKETCH) & (OF * np.minimum(sizes[x], sizes[y]) >= SHARE * np.maximum(sizes[x], sizes[y]))
        x, y, d = x[ok], y[ok], d[ok]
        us.append(x[~large[x]])
        vs.append(y[~large[x]])
        x, y, d = (a[large[x]] for a in (x, y, d))
        for i in range(NEAREST):  # each takes the place of the first that is farther, which moves on
            nearer = d < best[i, x]
            at = x[nearer]
            moved = best[i, at].copy(), to[i, at].copy()
            best[i, at], to[i, at] = d[nearer], y[nearer]
            d[nearer], y[nearer] = moved
    for i in range(NEAREST):
        x = np.flatnonzero(best[i] <= SKETCH)
        us.append(x)
        vs.append(to[i, x])
    u, v = nodes[np.concatenate(us)], nodes[np.concatenate(vs)]
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def meetings(prints: DataFrame) -> DataFrame:
    """(u, v, large): distinct pairs (u, v) that may be near copies, and the keys ``large`` of groups of over 33, whose pairs aren't all among
    them (``large_links`` finds those). ``prints``: node, fp, n, and ``keys`` as bytes.

    A task streams its groups: it holds a batch and the 33 rows before it, however large a group is. All pairs of a group of up
    to 33 meet. In a larger one, many near copies of one text or a passage that very many texts share, each text is compared with the 32
    behind it, in one of four orders, and meets the two nearest, so what is sent on is linear.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                rows = batch.slice(part, 1024)
                data = rows.column("keys").to_pylist()
                times = [len(d) // 8 for d in data]
                fp, n, node = (np.repeat(rows.column(c).to_numpy(), times) for c in ("fp", "n", "node"))
                keys = np.frombuffer(b"".join(data), np.int64)
                order = turned(fp.view(np.uint64), keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, order, n, node)], ["k", "o", "n", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], t) for t in (np.int64, np.int64, np.int32, np.int64)]
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("k", "o", "n", "node"))]
            # All fingerprints of a key are turned alike, so they differ as they did.
            u, v = near_pairs(rows[0], rows[1].view(np.uint64), rows[2], rows[3])
            large = np.unique(rows[0][: -WINDOW - 1][rows[0][: -WINDOW - 1] == rows[0][WINDOW + 1 :]])
            none = lambda n: pa.nulls(n, pa.int64())
            columns = [(pa.array(u), none(len(large))), (pa.array(v), none(len(large))), (none(len(u)), pa.array(large))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["u", "v", "large"])
            held = [x[-WINDOW - 1 :] for x in rows]

    rows = prints.select("node", "fp", "n", "keys").mapInArrow(spread, "k long, o long, n int, node long")
    return rows.repartition(partitions(prints.sparkSession), "k").sortWithinPartitions("k", "o").mapInArrow(meet, "u long, v long, large long").distinct()


def jaccard_reached(a: bytes, b: bytes) -> bool:
    """Whether two sets of hashes (sorted, as bytes) have a similarity of 0.8 or more; two empty ones have."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= SHARE * (len(x) + len(y) - both)


def shingle_sets(docs: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the ``ends`` (end) among the texts of ``docs`` (key, text): all hashes, sorted, as bytes. A table of its own, so that
    joins read plain exchanges and a text that is sent very often can be split."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(shingle_hashes(t.as_py() or b"", shingle), np.uint64)).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "shingles"])

    texts = docs.select("key", "text").join(ends.distinct(), F.col("key") == F.col("end"), "left_semi").dropDuplicates(["key"])
    return written(texts.mapInArrow(sets, "key long, shingles binary"), "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) of keys whose texts have a Jaccard similarity of 0.8 or more, by all their shingles (``shingle_sets``)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard_reached(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"))]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(judge, "u long, v long")


def set_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of a forest of all pairs of ``sets`` (distinct hashes) with a Jaccard similarity of 0.8 or more.

    A text whose shingles are less than 0.8 in other texts has no partner; without it others may have none, either. Those left are counted
    against all that aren't reached yet, by lists of the texts of each shingle, which are made anew when half of the texts are reached.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    row, column = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True)[1]
    while True:
        some = np.bincount(column)[column] > 1
        row, column = row[some], column[some]
        open_ = OF * np.bincount(row, minlength=len(sets)) >= SHARE * sizes
        some = open_[row]
        if some.all():
            break
        row, column = row[some], column[some]
    us, vs = [row[:0]], [row[:0]]

    def lists() -> tuple[np.ndarray, ...]:
        some = open_[row]
        r, c = row[some], column[some]
        order = np.argsort(c, kind="stable")
        return r[order], *(np.searchsorted(c[order], np.arange(columns), side) for side in ("left", "right"))

    columns = int(column.max()) + 1 if len(column) else 0
    texts, begins, ends = lists()
    listed = left = int(open_.sum())
    for start in np.flatnonzero(open_):
        queue = [start] if open_[start] else []
        left -= len(queue)
        open_[start] = False
        while queue and left:
            at = queue.pop()
            own = column[np.searchsorted(row, at) : np.searchsorted(row, at, "right")]
            n = ends[own] - begins[own]
            both = np.bincount(texts[np.repeat(begins[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            found = np.flatnonzero(open_ & (OF * both >= SHARE * (sizes + sizes[at] - both)))
            if len(found):
                open_[found] = False
                left -= len(found)
                us.append(np.full(len(found), at))
                vs.append(found)
                queue += found.tolist()
            if 2 * left < listed:
                texts, begins, ends = lists()
                listed = left
    return np.concatenate(us), np.concatenate(vs)


def members(nodes: DataFrame, large: DataFrame) -> DataFrame:
    """(k, node, n) of the groups ``large`` (k)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                rows = batch.slice(part, 1024)
                data = rows.column("keys").to_pylist()
                times = [len(d) // 8 for d in data]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(data), np.int64)), *(pa.array(np.repeat(rows.column(c).to_numpy(), times)) for c in ("node", "n"))], ["k", "node", "n"])

    return written(nodes.select("node", "n", "keys").mapInArrow(spread, "k long, node long, n int").join(large, "k"), "members")


def large_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that keep together all pairs of a similarity of 0.8 or more within the groups of ``rows`` (``members``).

    A group is dealt to blocks by hash. Each two blocks of it meet in a task, which holds no more than these and compares their texts by all
    shingles; it sends on a forest. A pair of texts that shares several groups is looked at in each.
    """
    spark = rows.sparkSession

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        at = None

        def out() -> pa.RecordBatch:
            nodes = np.array([n for n, _ in held], np.int64)
            u, v = set_links([np.frombuffer(s, np.uint64) for _, s in held])
            return pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

        for batch in batches:
            for *group, node, shingles in zip(*(batch.column(c).to_pylist() for c in ("k", "i", "j", "node", "shingles"))):
                if group != at:
                    if held:
                        yield out()
                    held, at = [], group
                held.append((node, shingles))
        if held:
            yield out()

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.join(rows.groupBy("k").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "k").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Two blocks have all pairs of each, too.
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 or other <> block")
    sent = others.select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node").join(sets.select(F.col("key").alias("node"), "shingles"), "node")
    met = sent.repartition(partitions(spark), "k", "i", "j").sortWithinPartitions("k", "i", "j").select("k", "i", "j", "node", "shingles")
    return met.mapInArrow(meet, "u long, v long").distinct()


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, key, key2, root, clash) of every row of ``docs`` (id, key, key2, text): texts of one root are near copies of each other, or
    linked by such.

    Nodes are texts, by their key. Texts are linked if their shingles have a Jaccard similarity of 0.8 or more; candidates are those with a
    class of shingles alike. Groups of a class of over 33 texts are compared pair by pair, by all shingles. Different texts can have one key of 64 bits; ``key2`` tells them apart, and ``clash`` says that a key has
    several.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                found = [class_prints(shingle_hashes(t.as_py() or b"", shingle)) for t in rows.column("text").cast(pa.binary())]
                keys, fps, sizes = pa.array([k.tobytes() for k, _, _ in found], pa.binary()), np.array([f for _, f, _ in found], np.uint64), np.array([n for _, _, n in found], np.int32)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "key", "key2")), pa.array(fps.view(np.int64)), pa.array(sizes), keys], ["id", "key", "key2", "fp", "n", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = written(docs.select("id", "key", "key2", "text").mapInArrow(of, f"id {kind}, key long, key2 long, fp long, n int, keys binary"), "prints")
    nodes = rows.groupBy(F.col("key").alias("node")).agg(F.first(F.struct("fp", "n", "keys")).alias("x"), (F.min("key2") != F.max("key2")).alias("clash")).select("node", "x.*", "clash")
    met = written(meetings(nodes), "pairs")
    pairs, large = met.filter("large is null").select("u", "v"), written(met.filter("large is not null").select(F.col("large").alias("k")), "large")
    ends = pairs.select(F.col("u").alias("end")).unionByName(pairs.select(F.col("v").alias("end")))
    if large.isEmpty():
        edges = verified(pairs, shingle_sets(docs, ends, shingle))
    else:
        rest = members(nodes, large)
        sets = shingle_sets(docs, ends.unionByName(rest.select(F.col("node").alias("end"))), shingle)
        edges = verified(pairs, sets).unionByName(large_links(rest, sets))
    roots = written(rooted(nodes.select("node"), edges).join(nodes.select("node", "clash"), "node"), "roots")
    return rows.select("id", "key", "key2").join(roots, F.col("key") == F.col("node")).select("id", "key", "key2", "root", "clash")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: the least id (a null id comes last)."""
    key, key2, nth, keep_id, keep_key, keep_key2 = (fresh(docs, n) for n in ("near_key_", "near_key2_", "near_nth_", "keep_id_", "keep_key_", "keep_key2_"))
    source = F.col(quoted(text))
    rows = docs.withColumns({key: text_key(source), key2: text_key(source, 1)})
    found = near_copies(rows.select(F.col(quoted(doc_id)).alias("id"), F.col(key).alias("key"), F.col(key2).alias("key2"), source.alias("text")), shingle)
    # Texts that clash in a key are groups of their own, as none may go for the other.
    group = found.groupBy("root", F.when(F.col("clash"), F.col("key2")).alias("own"))
    kept = group.agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "key2")).alias("k")).select(F.col("k.id").alias(keep_id), F.col("k.key").alias(keep_key), F.col("k.key2").alias(keep_key2))
    out = rows.join(kept, F.col(quoted(doc_id)).eqNullSafe(F.col(keep_id)) & (F.col(key) == F.col(keep_key)) & (F.col(key2) == F.col(keep_key2)), "left_semi")
    # Rows alike in id and text: one stays.
    numbered = out.withColumn(nth, F.row_number().over(W.partitionBy(quoted(doc_id), key, key2).orderBy(key)))
    return numbered.filter(F.col(nth) == 1).select(*map(quoted, docs.columns))
