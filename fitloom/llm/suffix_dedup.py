"""Operator 2: removal of repeated byte strings by a difference-cover suffix index, built one bucket at a time.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in any document or in its own. So only the
first ``LENGTH`` bytes of a suffix count, and what is asked of the suffix order is which suffixes are tied with a neighbour over all
of them. Suffixes are held as 64-bit polynomial hashes of fixed depths; a bucket is a range of hash values, and each bucket is sorted
alone, in the memory of one task. Not every suffix is sorted. A difference cover D modulo v has, for any two places i and j, an
offset d < v at which both i + d and j + d are cover samples; ranks of samples that are computed beforehand decide all other ties:

1. Cover samples (v = 307, 18 of them) are ranked to a depth of 94 bytes. A suffix all of whose samples within v have a rank of
   their own is tied with nothing: two equal strings of 400 bytes would have two equal samples inside.
2. In what is left, samples of a finer cover (v = 57, 8 of them) are ranked to a depth of 344 bytes, which rules suffixes out as
   before. The strings of 456 bytes from 56 before a sample on hold the 400 bytes of each suffix that starts there or up to 56
   before. If as many places have this longer string as have the sample's rank, all of them are tied over it: the 57 suffixes are
   settled, and no other suffix can be tied with one of them by way of this sample.
3. Of samples whose rank falls apart, in part or as a whole, the 57 suffixes are sorted by all 400 bytes.

Ranks go back as counts. Between rounds a document is known by a 128-bit digest of its text. Of exact copies one text is looked at;
all copies of 400 bytes or more go whole. Equal keys of a block of documents are sent once, with their number, so a bucket gets at
most one row a block of any string, however often it occurs.

Equal hashes of 128 bits are taken as equal strings in rounds 2 and 3: for n strings sorted there the chance of one false tie is about
n * n / 2**129. ``wide=False`` compares 64 bits, for inputs of up to some 10**9 such strings.

Null text: an empty text; texts under ``LENGTH`` bytes lose nothing unless all are read with a smaller ``LENGTH``. Repeated rows are
exact copies. Null ids come through. Extra columns are not looked at. A long text is hashed in segments, in the row of one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import partitions, written

LENGTH = 400
SEGMENT = 1 << 20
BLOCK_BYTES = 4 << 20
#: Counts are sent back in 32 bits; one that reaches the limit settles nothing.
MOST = (1 << 32) - 1
#: Keys that one bucket is to hold, about; there are two buckets a task at least.
BUCKET_KEYS = 1 << 20


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, D) with v = q * q + q + 1 and q + 1 residues: each difference modulo v occurs once (Singer's construction, q prime).

    In the field of q**3 elements, D are the powers of a generator whose coordinate along x**2 is zero.
    """
    v = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            for c2 in range(q):  # x**3 = c0 + c1 x + c2 x**2
                e, out = (1, 0, 0), []
                for i in range(v):
                    if e[2] == 0:
                        out.append(i)
                    e = (e[2] * c0 % q, (e[0] + e[2] * c1) % q, (e[1] + e[2] * c2) % q)
                if len(out) == q + 1 and len({(a - b) % v for a in out for b in out if a != b}) == v - 1:
                    return v, np.array(out)
    raise ValueError("q must be prime")


class Cover:
    """Sample places of a cover modulo v, for strings of ``length`` bytes."""

    def __init__(self, q: int, length: int):
        self.v, self.residues = difference_cover(q)
        self.core = length - self.v + 1
        self.span = length + self.v - 1
        self.before = self.v - 1
        if self.core < 1:
            raise ValueError("the cover is too wide for this length")
        self.places = np.array([], np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": self.places[:0]}

    def upto(self, last: int) -> np.ndarray:
        """Sample places from 0 to ``last``."""
        if last < 0:
            return self.places[:0]
        if not len(self.places) or self.places[-1] < last + self.v:
            n = (2 * last) // self.v + 2
            self.places = (np.arange(n)[:, None] * self.v + self.residues[None, :]).ravel()
        return self.places[: np.searchsorted(self.places, last, "right")]


class Hasher:
    """Polynomial hashes of windows modulo 2**64 over random byte values; by prefix sums, a segment of the text at a time."""

    def __init__(self, seed: int, most: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 8 + 5
        n = SEGMENT + most + 1
        self.powers, self.inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (np.uint64(base % (1 << 64)), np.uint64(pow(base, -1, 1 << 64))))

    def windows(self, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """The hash of ``data[p : p + length]`` for each p of the sorted ``at``."""
        out = np.empty(len(at), np.uint64)
        done = 0
        while done < len(at):
            first = int(at[done])
            upto = int(np.searchsorted(at, first + SEGMENT, "left"))
            here = at[done:upto] - first
            part = data[first : int(at[upto - 1]) + length]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.values[part] * self.powers[: len(part)], out=sums[1:])
            out[done:upto] = (sums[here + length] - sums[here]) * self.inverse[here]
            done = upto
        return out ^ (out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


@cache
def hasher(seed: int, most: int) -> Hasher:
    """Its tables are large; each worker makes its own."""
    return Hasher(seed, most)


def within(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places below n that one of the intervals [begin, end) covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, np.clip(begins, 0, n), 1)
    np.add.at(steps, np.clip(ends, 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


class Rounds:
    """What each round looks at in a document, as a rule of its text and of the bits that the rounds before gave."""

    def __init__(self, length: int = LENGTH, coarse: int = 17, fine: int = 7, wide: bool = True):
        self.length, self.wide = length, wide
        self.coarse, self.fine = Cover(coarse, length), Cover(fine, length)
        self.words = 1 + wide

    def keys(self, data: np.ndarray, at: np.ndarray, length: int, tag: int, width: int) -> np.ndarray:
        """A row of ``width`` words a place."""
        tag_ = np.uint64(tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return np.stack([hasher(seed, self.fine.span).windows(data, at, length) ^ tag_ for seed in range(width)], axis=1)

    def suspects(self, n: int, bits: bytes) -> np.ndarray:
        """Starts that round 1 leaves."""
        at = self.coarse.upto(n - self.coarse.core)
        tied = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)]
        return within(max(0, n - self.length + 1), tied - self.coarse.v + 1, tied + 1)

    def fine_places(self, n: int, suspects: np.ndarray) -> np.ndarray:
        """Samples of the fine cover that a suspect has within its v."""
        at = self.fine.upto(n - self.fine.core)
        sums, m = np.r_[0, np.cumsum(suspects)], len(suspects)
        return at[sums[np.minimum(at + 1, m)] > sums[np.minimum(np.maximum(at - self.fine.before, 0), m)]]

    def settled(self, n: int, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(starts that round 2 shows to be tied, starts that round 3 is to look at)."""
        suspects = self.suspects(n, bits[0])
        at, m = self.fine_places(n, suspects), len(suspects)
        sure, still = np.unpackbits(np.frombuffer(bits[1], np.uint8), count=2 * len(at)).astype(bool).reshape(2, -1)
        over = lambda x: within(m, x - self.fine.before, x + 1)
        return over(at[sure]), suspects & over(at[still])

    def ask(self, data: np.ndarray, bits: list[bytes], alone: int) -> np.ndarray:
        """The keys of the next round; ``alone`` is a number of this document's own."""
        n, words = len(data), self.words
        if not bits:
            return self.keys(data, self.coarse.upto(n - self.coarse.core), self.coarse.core, 1, 1)
        if len(bits) == 1:
            at = self.fine_places(n, self.suspects(n, bits[0]))
            core = self.keys(data, at, self.fine.core, 2, words)
            whole = (at >= self.fine.before) & (at + self.length <= n)
            # A place without the longer string gets a key of its own.
            span = core ^ (at.astype(np.uint64)[:, None] + np.uint64(alone)) * np.uint64(0xC2B2AE3D27D4EB4F)
            span[whole] = self.keys(data, at[whole] - self.fine.before, self.fine.span, 3, words)
            return np.concatenate([core, span])
        return self.keys(data, np.flatnonzero(self.settled(n, bits)[1]), self.length, 4, words)

    def read(self, number: int, counts: np.ndarray) -> np.ndarray:
        """The bits that later rounds need of one document's counts."""
        if number != 1:
            return counts > 1
        core, span = counts.reshape(2, -1)
        sure = (core > 1) & (span == core) & (core < MOST)
        return np.concatenate([sure, (core > 1) & ~sure])

    def starts(self, n: int, bits: list[bytes]) -> np.ndarray:
        """Whether the string from each place on occurs elsewhere."""
        sure, still = self.settled(n, bits)
        at = np.flatnonzero(still)
        sure[at[np.unpackbits(np.frombuffer(bits[2], np.uint8), count=len(at)).astype(bool)]] = True
        return sure


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key the sum of the counts of all keys like it. The bucket is sorted once."""
    order = np.lexsort(keys.T) if keys.shape[1] > 1 else np.argsort(keys[:, 0])
    s = keys[order]
    group = np.cumsum(np.r_[True, (s[1:] != s[:-1]).any(axis=1)]) - 1 if len(s) else np.array([], np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.bincount(group, counts[order]).astype(np.int64)[group]
    return out


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the first of equal keys, for every key which of them it is, how many are like each)."""
    rows = keys[:, 0] if keys.shape[1] == 1 else np.ascontiguousarray(keys).view([("", np.uint64)] * keys.shape[1]).ravel()
    _, first, which, counts = np.unique(rows, return_index=True, return_inverse=True, return_counts=True)
    return first, which.ravel(), counts


def one_round(texts: DataFrame, rounds: Rounds, number: int, total: int, width: int) -> DataFrame:
    """(d1, d2, bits) of the documents of ``texts`` (d1, d2, text, bits1..) that have a tied key in this round.

    Two shuffles: keys to their buckets, bits back to their blocks. A block is some documents of one task; beside its keys it sends
    how they are to be put together again. Its name is a digest of what is in it, so a task that runs again sends the same.
    """
    names = [f"bits{k + 1}" for k in range(number)]
    n = partitions(texts.sparkSession)
    shift = np.uint64(64 - min(32, max(total // BUCKET_KEYS, 2 * n).bit_length()))
    keep = width  # bytes of the first word that are sent

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        digests, counts, keys, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(keys)
            first, which, times = first_of_each(every)
            new = np.zeros(len(every), bool)
            new[first] = True
            by_place = np.argsort(first)  # distinct keys in the order of the text
            nth = np.argsort(by_place)
            distinct, times = every[first[by_place]], times[by_place]
            bucket = (distinct[:, 0] >> shift).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            found, begins = np.unique(bucket[order], return_index=True)
            data, times = distinct[order].view(np.uint8).reshape(len(order), -1), times[order].astype("<u4")
            data = np.ascontiguousarray(np.concatenate([data[:, :keep], data[:, 8:]], axis=1))
            rows = [data[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(begins, np.r_[begins[1:], len(order)])]
            head = np.array(digests, np.int64)
            block = hashlib.blake2b(head.tobytes(), digest_size=16).digest()
            plan = pickle.dumps((head, np.array(counts), np.packbits(new), bucket.astype(np.min_scalar_type(int(bucket.max()))), nth[which[~new]].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([*found.tolist(), -1 - int.from_bytes(block[:6], "big")], pa.int64()), pa.array([block] * (len(rows) + 1), pa.binary()), pa.array([*rows, plan], pa.binary())], ["bucket", "block", "data"])

        for batch in batches:
            columns = [batch.column(n) for n in ("d1", "d2", *names)]
            for r, text in enumerate(batch.column("text").cast(pa.binary())):
                d1, d2, *bits = (c[r].as_py() for c in columns)
                if (d1, d2) in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add((d1, d2))
                mine = rounds.ask(np.frombuffer(text.as_buffer(), np.uint8), bits, d1 & (1 << 63) - 1)
                if not len(mine):
                    continue
                digests.append((d1, d2))
                counts.append(len(mine))
                keys.append(mine)
                size += mine.nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    digests, counts, keys, size = [], [], [], 0
        if keys:
            yield flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            step = keep + 8 * (rounds.words - 1) * (number > 0)
            sizes = [len(d) // (step + 4) for _, d in held]
            data = np.concatenate([np.frombuffer(d, np.uint8, n * step).reshape(n, step) for n, (_, d) in zip(sizes, held)])
            times = np.concatenate([np.frombuffer(d, "<u4", n, n * step) for n, (_, d) in zip(sizes, held)])
            first = np.zeros((len(data), 8), np.uint8)
            first[:, :keep] = data[:, :keep]
            sums = np.minimum(totals(np.concatenate([first, data[:, keep:]], axis=1).view(np.uint64), times), MOST).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([now] * len(held), pa.int64()), pa.array([b for b, _ in held], pa.binary()), pa.array([x.tobytes() for x in np.split(sums, np.cumsum(sizes)[:-1])], pa.binary())], ["bucket", "block", "data"])

        for batch in batches:
            for bucket, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([block], pa.binary()), pa.array([data], pa.binary())], ["bucket", "block", "data"])
                    continue
                if bucket != now and held:
                    yield done()
                    held = []
                now = bucket
                held.append((block, data))
        if held:
            yield done()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, parts, now = None, {}, None

        def done() -> pa.RecordBatch:
            if plan is None:
                raise RuntimeError("a block has lost its plan; the input's order changed while it was read")
            head, sizes, new, bucket, again = pickle.loads(plan)
            new = np.unpackbits(new, count=int(sizes.sum())).astype(bool)
            sent, every = np.empty(len(bucket), np.int64), np.empty(len(new), np.int64)
            order = np.argsort(bucket, kind="stable")
            sent[order] = np.concatenate([np.frombuffer(parts[b], "<u4") for b in np.unique(bucket).tolist()])
            every[new], every[~new] = sent, sent[again]
            each = [(h, rounds.read(number, x)) for h, x in zip(head.tolist(), np.split(every, np.cumsum(sizes)[:-1]))]
            each = [(h, np.packbits(x).tobytes()) for h, x in each if number or x.any()]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h, _ in each], pa.int64()), pa.array([h[1] for h, _ in each], pa.int64()), pa.array([x for _, x in each], pa.binary())], ["d1", "d2", "bits"])

        for batch in batches:
            for bucket, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now and now is not None:
                    yield done()
                    plan, parts = None, {}
                now = block
                if bucket < 0:
                    plan = data
                else:
                    parts[bucket] = data
        if now is not None:
            yield done()

    spark, rows = texts.sparkSession, "bucket long, block binary, data binary"
    sent = texts.select("d1", "d2", "text", *names).mapInArrow(send, rows)
    ranked = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, rows)
    back = ranked.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(gather, "d1 long, d2 long, bits binary")
    # A text that several tasks hold comes back from each, with the same bits.
    return back.groupBy("d1", "d2").agg(F.first("bits").alias(f"bits{number + 1}"))


def digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), F.octet_length(text).cast("long").alias("n_bytes"))


def trimmed(docs: DataFrame, length: int = LENGTH, coarse: int = 17, fine: int = 7, wide: bool = True) -> DataFrame:
    """(d1, d2, n_removed, n_spans, kept) of each text that loses something, exact copies aside; ``kept`` is what is left, as bytes."""
    rounds = Rounds(length, coarse, fine, wide)
    rows = digested(docs)
    texts = rows.filter(F.col("n_bytes") >= length).select("d1", "d2", "text")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    density = lambda c: len(c.residues) / c.v
    first = written(one_round(texts, rounds, 0, int(total * density(rounds.coarse)), 6), "ranks")
    one = written(texts.join(first, ["d1", "d2"]).mapInArrow(once, "d1 long, d2 long, text string, bits1 binary"), "suspects")
    left = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    second = written(one_round(one, rounds, 1, int(2 * left * density(rounds.fine)), 8), "fine")
    two = one.join(second, ["d1", "d2"])
    third = written(one_round(two, rounds, 2, left // 4, 8), "open")
    three = two.join(third, ["d1", "d2"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, text in enumerate(batch.column("text").cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                starts = np.flatnonzero(rounds.starts(len(data), [batch.column(f"bits{k}")[r].as_py() or b"" for k in (1, 2, 3)]))
                gone = within(len(data), starts, starts + length)
                if gone.any():
                    out.append((batch.column("d1")[r].as_py(), batch.column("d2")[r].as_py(), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), data[~gone].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["d1", "d2", "n_removed", "n_spans", "kept"])

    return three.select("d1", "d2", "text", "bits1", "bits2", "bits3").mapInArrow(cut, "d1 long, d2 long, n_removed long, n_spans long, kept binary")


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest the task has not met; a text that stays twice does no harm."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for r, d in enumerate(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist())):
            if d not in seen:
                new.append(r)
                if len(seen) < 1 << 18:
                    seen.add(d)
        yield batch.take(pa.array(new, pa.int64()))


def deduped(docs: DataFrame, length: int = LENGTH, coarse: int = 17, fine: int = 7, wide: bool = True, with_text: bool = False) -> DataFrame:
    """The query's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds ``kept``, null where nothing went."""
    rows = digested(docs).select("doc_id", "d1", "d2", "n_bytes", F.sha2("text", 256).alias("sha"))
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("d1", "d2").agg(F.count("*").alias("copies")).filter("copies > 1")
    cut = trimmed(docs, length, coarse, fine, wide)
    cut = cut.dropDuplicates(["d1", "d2"]) if with_text else cut.select("d1", "d2", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha")).distinct()
    gone = F.col("copies").isNotNull()
    # One row a text, as a table: the join below reads two plain exchanges, and copies of one text in any number can be split.
    found = written(copies.join(cut, ["d1", "d2"], "full"), "found")
    out = rows.join(found, ["d1", "d2"], "left")
    sha = F.sha2("kept", 256) if with_text else F.col("cut_sha")
    columns = [
        F.col("doc_id"), F.col("n_bytes"), F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(sha, F.col("sha"))).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []))
