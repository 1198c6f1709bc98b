"""Operator 9: token ids in binary shards with a minimal perfect hash index.

Documents are dealt by ranges of their id; each range becomes one shard of two files in the shared folder:

``NNNNN.bin``  the ids of all its documents, one after the other, little-endian, 2 or 4 bytes each (as the vocabulary needs), raw.
``NNNNN.idx``  ``FLT2``, the id width, the numbers of documents and ids, the hash seed and the number of buckets; then per bucket of the
               hash a displacement, per slot a record of fingerprint, offset and length (in ids), and the document keys in order.

The index is a minimal perfect hash (hash and displace): a key's bucket gives a displacement, key and displacement give its slot,
and every slot is used. A key that is not in the shard meets a fingerprint that differs, but for one in 2**32. A lookup (``find``) seeks
one displacement and one record, however many keys there are; only the head is read when a shard is opened. ``whole`` reads all keys
and records at once, and ``payloads`` the ids of all documents in ranges of some megabytes.

There are as many shards as keep each under ``SHARD_BYTES`` of text and ``SHARD_ROWS`` documents on the average, and at least as many as
shuffle partitions; the memory of a task goes by these two, not by the table. Ranges are of the id and the first characters of the
text, so rows that share an id, or have none, spread over several shards.

Files are written under a name of the attempt and renamed, so a repeated or lost task leaves whole files. Null text: an empty text
(only the end id). Null ids come first in the order. Ids are integers; another kind must be castable to long, or the job ends with a
cast error. Rows that share an id are told apart by their number among them in their shard, in order of text; both parts make the key.
Extra columns are not looked at. A long text is encoded whole in one row.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.llm.common import partitions, quoted, scratch, written

MAGIC = b"FLT2"
HEAD = struct.Struct("<4sBqqQq")
SLOT = np.dtype([("print", "<u4"), ("offset", "<i8"), ("length", "<i8")])
#: What a shard holds at most, on the average.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 4_000_000
#: Bytes that are read at once of a payload.
READ_BYTES = 8 << 20
KEYS_A_BUCKET = 4
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
END_ID = 1


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed (splitmix's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """Distinct for distinct ids of number 0; others may collide, which the build meets with another seed."""
    return mix(ids.view(np.uint64) ^ mix(nth.view(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), seed + 1) ^ mix(np.zeros(1, np.uint64), seed + 1), seed)


class MinimalPerfectHash:
    """Displacements of the buckets: at least 0 for a seed that places a bucket's keys, else minus the slot of its only key minus 1."""

    def __init__(self, n: int, displacements: np.ndarray):
        self.n, self.displacements = n, displacements

    @staticmethod
    def spread(h: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
        return (mix(h ^ np.asarray(d, np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 7) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> MinimalPerfectHash | None:
        """None if two keys have one hash."""
        n = len(h)
        if len(np.unique(h)) < n:
            return None
        m = max(1, -(-n // KEYS_A_BUCKET))
        bucket = cls.bucket(h, m)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        starts = np.cumsum(sizes) - sizes
        used = np.zeros(n, bool)
        out = np.zeros(m, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            keys = h[order[starts[b] : starts[b] + sizes[b]]]
            d = 0
            while True:  # 64 displacements at a time
                tries = np.arange(d, d + 64)
                slots = cls.spread(keys[None, :], tries[:, None], n)
                s = np.sort(slots, axis=1)
                good = np.flatnonzero(~used[slots].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(good):
                    out[b] = d + good[0]
                    used[slots[good[0]]] = True
                    break
                d += 64
        single = by_size[sizes[by_size] == 1]
        out[single] = -np.flatnonzero(~used)[: len(single)] - 1
        return cls(n, out)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return self.slot(h, self.displacements[self.bucket(h, len(self.displacements))], self.n)

    @staticmethod
    def bucket(h: np.ndarray, m: int) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(m)).astype(np.int64)

    @classmethod
    def slot(cls, h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        """By the displacements ``d`` of their buckets."""
        return np.where(d < 0, -d - 1, cls.spread(h, np.maximum(d, 0), n))


class Shard:
    """One pair of files, opened for keyed reads."""

    def __init__(self, folder: str, name: str):
        files, path = open_fs(folder)
        self.index, self.payload = files.open_input_file(f"{path}/{name}.idx"), files.open_input_file(f"{path}/{name}.bin")
        magic, self.width, self.n, self.n_ids, self.seed, self.buckets = HEAD.unpack(self.index.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not an index of this format")
        self.slots_at = HEAD.size + 8 * self.buckets
        self.keys_at = self.slots_at + SLOT.itemsize * self.n

    def find(self, ids: np.ndarray, nth: np.ndarray | None = None, nulls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key, by two seeks a key."""
        ids = np.asarray(ids, np.int64)
        h = key_hash(ids, np.zeros(len(ids), bool) if nulls is None else nulls, np.zeros(len(ids), np.int64) if nth is None else nth, self.seed)
        bucket = MinimalPerfectHash.bucket(h, self.buckets)
        displacements = np.frombuffer(b"".join(self.index.read_at(8, HEAD.size + 8 * b) for b in bucket.tolist()), "<i8")
        slots = MinimalPerfectHash.slot(h, displacements, self.n)
        records = np.frombuffer(b"".join(self.index.read_at(SLOT.itemsize, self.slots_at + SLOT.itemsize * s) for s in slots.tolist()), SLOT)
        return records["print"] == print_of(h), records["offset"], records["length"]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, nulls, offsets, lengths) of all documents in order, each looked up by its key in the index."""
        data = self.index.read_at(self.index.size() - HEAD.size, HEAD.size)
        at = 0

        def take(kind: str | np.dtype, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        displacements, records = take("<i8", self.buckets), take(SLOT, self.n)
        ids, nth, nulls = take("<i8", self.n), take("<i8", self.n), take("?", self.n)
        h = key_hash(ids, nulls, nth, self.seed)
        found = records[MinimalPerfectHash.slot(h, displacements[MinimalPerfectHash.bucket(h, self.buckets)], self.n)]
        if not (found["print"] == print_of(h)).all():
            raise ValueError("the index does not find its own keys")
        return ids, nulls, found["offset"], found["length"]

    def read(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.payload.read_at(length * self.width, offset * self.width), f"<u{self.width}")

    def payloads(self, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each document; ``offsets`` ascend. Neighbours are read together."""
        ends = offsets + lengths
        done, most = 0, READ_BYTES // self.width
        while done < len(offsets):
            first = int(offsets[done])
            upto = max(done + 1, int(np.searchsorted(ends, first + most, "right")))
            data = self.read(first, int(ends[upto - 1]) - first)
            for o, n in zip((offsets[done:upto] - first).tolist(), lengths[done:upto].tolist()):
                yield data[o : o + n]
            done = upto


def print_of(h: np.ndarray) -> np.ndarray:
    return (mix(h, 11) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def build_index(ids: np.ndarray, nth: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    seed, mph, h = 0, None, ids
    while mph is None:
        h = key_hash(ids, nulls, nth, seed)
        mph = MinimalPerfectHash.build(h)
        seed += mph is None
    slots = mph.slots(h)
    n = len(ids)
    records = np.empty(n, SLOT)
    records["print"][slots], records["offset"][slots], records["length"][slots] = print_of(h), np.cumsum(lengths) - lengths, lengths
    head = HEAD.pack(MAGIC, width, n, int(lengths.sum()), seed, len(mph.displacements))
    return b"".join([head, *(np.ascontiguousarray(x).tobytes() for x in (mph.displacements, records, ids, nth, nulls))])


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space: what stands between white space is encoded alone and remembered.

    A text of letters of ASCII and Latin-1 and ASCII punctuation needs no more of the library than its merges: such letters are normal
    as they are, and runs of letters and of punctuation are tokens apart. Pieces of other texts go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.simple = (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.flat, self.begin, self.size = np.array([], np.uint32), np.array([], np.int64), np.array([], np.int64)

    def pieces(self, text: str) -> list[str]:
        """What to encode alone: runs of letters and of punctuation in lower case, or what stands between ASCII white space."""
        if self.simple and SIMPLE.fullmatch(text) and not any(x in text for x in self.special):
            return MARKS.sub(r" \g<0> ", text.lower()).split()
        return [w.decode() for w in text.encode().split()]

    def ids(self, piece: str) -> list[int]:
        if self.simple and RUN.fullmatch(piece):
            return [t.id for t in self.merge(piece if piece.isascii() else "".join(BYTE_LETTERS[b] for b in piece.encode()))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id behind each, length of each)."""
        if len(self.known) > REMEMBERED:
            self.reset()
        words = [self.pieces(t) for t in texts]
        every = list(chain.from_iterable(words))
        known = self.known
        at = np.fromiter(map(known.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            base = len(known)
            new = list(dict.fromkeys(map(every.__getitem__, missing)))
            known.update(zip(new, range(base, base + len(new))))
            ids = list(map(self.ids, new))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(sizes) - sizes]
            self.size = np.r_[self.size, sizes]
            self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))]
            at[missing] = [known[every[i]] for i in missing]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        bounds = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        upto = np.r_[0, ends][bounds]
        flat = self.flat[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return np.insert(flat, upto, END_ID), np.diff(np.r_[0, upto]) + 1


# The tokenizer's own rules under which a simple chunk may be cut without them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters, ASCII punctuation other than the apostrophe, and white space; runs of either of the first two.
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~ \t-\r]*")
MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")
RUN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones of Latin-1 for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


BYTE_LETTERS = byte_letters()


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of ``path``, loaded once in a worker with what it remembers."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_store(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, shards: int | None = None) -> tuple[str, DataFrame]:
    """Write the shards; returns their folder and (shard, n_docs, n_ids, base), base being the number of ids in the shards before."""
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(quoted(text)).cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
        shards = max(partitions(spark), -(-(size["bytes"] or 0) // SHARD_BYTES), -(-size["rows"] // SHARD_ROWS))
    path, folder = tokenizer or default_tokenizer(), scratch(spark, "tokens")
    files, at = open_fs(folder)
    files.create_dir(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(path)
        width = 2 if words.tokenizer.get_vocab_size() <= 1 << 16 else 4
        files, at = open_fs(folder)
        task = TaskContext.get()
        name, attempt = f"{task.partitionId():05d}", f".{task.taskAttemptId()}-{uuid.uuid4().hex}"
        ids, nulls, lengths, out = [], [], [], None
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                if out is None:
                    out = files.open_output_stream(f"{at}/{attempt}.bin")
                flat, sizes = words.encode([t or "" for t in rows.column("t").to_pylist()])
                out.write(flat.astype(f"<u{width}").tobytes())
                ids.append(rows.column("k").fill_null(0).to_numpy())
                nulls.append(rows.column("k").is_null().to_numpy(zero_copy_only=False))
                lengths.append(sizes)
        if out is None:
            return
        out.close()
        ids, nulls, lengths = np.concatenate(ids), np.concatenate(nulls), np.concatenate(lengths)
        fresh = np.r_[True, (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])]
        nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        with files.open_output_stream(f"{at}/{attempt}.idx") as f:
            f.write(build_index(ids, nth, nulls, lengths, width))
        for end in ("bin", "idx"):
            files.move(f"{at}/{attempt}.{end}", f"{at}/{name}.{end}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n_docs": [len(ids)], "n_ids": [int(lengths.sum())]})

    rows = docs.select(F.col(quoted(key)).cast("long").alias("k"), F.col(quoted(text)).alias("t"))
    dealt = rows.repartitionByRange(shards, F.col("k"), F.substring("t", 1, 64)).sortWithinPartitions("k", "t")
    manifest = written(dealt.mapInArrow(write, "shard long, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    return folder, manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_store(folder: str, manifest: DataFrame, of: Callable[[Shard, int], pa.RecordBatch], schema: str, shards: int) -> DataFrame:
    """``of(shard, base)`` of every shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield of(Shard(folder, f"{row['shard']:05d}"), row["base"])

    return manifest.repartition(shards, "shard").mapInArrow(read, schema)


def read_back(shard: Shard, base: int) -> pa.RecordBatch:
    """The query's columns of one shard, each document looked up by its key."""
    ids, nulls, offsets, lengths = shard.whole()
    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in shard.payloads(offsets, lengths)]
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(base + offsets), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def stored(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    folder, manifest = write_store(docs.select("doc_id", "text"))
    return read_store(folder, manifest, read_back, "doc_id long, start long, n_tokens long, ids_crc32 long", partitions(docs.sparkSession))
