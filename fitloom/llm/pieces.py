"""Operator 7: SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file gives three machines. N, the normaliser, replaces the longest prefix that its rules know (none in a model without rules),
squeezes blanks where the model says so, maps them to U+2581 and puts one in front. P, the piece machine, is a trie whose final states
put out a piece id at the piece's weight; a character that no piece covers leaves it through byte fallback. B, the machine of
byte-pair models, has the last piece as its state and lets another follow only if merging their two texts afresh gives the two pieces
back; for unigram models it has one state. A piece weighs minus its score: its rank among the merges, or minus its log probability.

Encoding composes N, P and B with the input as far as the search gets and takes the path of least weight in the tropical semiring: the
arcs out of a place are relaxed, so that each place keeps the least sum of weights over the arcs that reach it. A segmentation in which
every neighbouring pair is let by B is the one that the merges give, so with B each place is reached by one finite path, that of the
merges of all before it, and it is one state. That holds where no piece ranks before the pieces that it is merged of. A model that has
such pieces has no machine B of pairs; it is encoded by its merges as they are (``Merges``).

No piece has U+2581 behind another character, so the lattice falls apart at each such place; chunks are solved alone and
remembered. Where a model has such pieces, a text is one chunk.

Null text: encoded as an empty text, no ids, decoded as an empty text. Each row gives one row. Extra columns are not looked at. A long
text is cut into chunks in one row; its work is linear in its characters.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# The piece types and model types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")
#: Chunks that a worker remembers before it starts afresh, and how long they may be.
REMEMBERED, LONGEST = 700_000, 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Rules:
    """The normaliser's replacement rules: a double-array trie of byte strings, each with the place of what replaces it.

    Of a unit of the trie, 8 bits are the label, bit 8 says that a string ends here, the rest is the way on.
    """

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist()
        self.texts = data[4 + size :]
        self.known: dict[str, tuple[int, str] | None] = {}

    @staticmethod
    def way(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def match(self, data: bytes, at: int) -> tuple[int, str] | None:
        """(length in bytes, replacement) of the longest rule that fits ``data`` from ``at`` on."""
        units, found = self.units, None
        place = self.way(units[0])
        for n in range(1, len(data) - at + 1):
            byte = data[at + n - 1]
            place ^= byte
            unit = units[place]
            if unit & 0x800000FF != byte:
                break
            place ^= self.way(unit)
            if unit >> 8 & 1:
                begin = units[place] & 0x7FFFFFFF
                found = n, self.texts[begin : self.texts.index(0, begin)].decode()
        return found

    def apply(self, text: str) -> str:
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            found = self.match(data, at)
            if found:
                out.append(found[1])
                at += found[0]
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + n].decode())
                at += n
        return "".join(out)


class Transducer:
    """The machines of one model file, and what they have solved so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.prefix, self.squeeze, self.escape, charsmap = UNIGRAM, True, True, True, b""
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.model_type = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                charsmap = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.rules = Rules(charsmap) if charsmap else None
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k in (NORMAL, USER)}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.out = [t.replace(MARK, " ").encode() if k in (NORMAL, USER) else bytes([int(t[3:5], 16)]) if k == BYTE else b"" for t, k in zip(self.texts, self.kinds)]
        self.fallback = max((-s for s in self.scores), default=0.0) + 10.0
        #: The trie of P, compiled: a character leads to (the piece that ends there or -1, the way on or None).
        self.trie: dict = {}
        for text, i in self.ids.items():
            if self.model_type == UNIGRAM or self.merged(text) == [text]:
                node, so_far = self.trie, ()
                for c in text[:-1]:
                    so_far = node.setdefault(c, (-1, {}))
                    if so_far[1] is None:
                        so_far = node[c] = so_far[0], {}
                    node = so_far[1]
                node[text[-1]] = i, node.get(text[-1], (-1, None))[1]
        self.split = all(MARK not in t.lstrip(MARK) for t in self.ids)
        self.together = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        #: Chunks end before each U+2581, and line feeds are chunks of their own where they stand in no piece with others.
        alone = "" if any("\n" in pair for pair in self.together) else "\n"
        self.chunk = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        self.follows: dict[int, bool] = {}
        self.reset()
        self.by_merges = False
        if self.model_type == BPE:
            self.compile_merges()

    def reset(self) -> None:
        """Forget the chunks that were solved: their numbers, the ids of all of them, one after the other, and how often each was met."""
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size, self.met = np.array([], np.int32), np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)

    def forget(self) -> None:
        """Keep the half of the chunks that was met most often."""
        words, at = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        kept = np.flatnonzero(self.met[at] > np.partition(self.met[at], -REMEMBERED // 2)[-REMEMBERED // 2])
        at = at[kept]
        self.flat, self.size, self.met = self.gather(at), self.size[at], self.met[at] // 2
        self.begin = np.cumsum(self.size) - self.size
        self.known = dict(zip(map(words.__getitem__, kept.tolist()), range(len(kept))))

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of solved chunks, one after the other."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def merged(self, text: str) -> list[str]:
        """What the model's merges leave of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            k = self.next_merge(parts)
            if k is None:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def next_merge(self, parts: list[str]) -> int | None:
        ranked = [(-self.scores[self.ids[parts[k] + parts[k + 1]]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.ids]
        return min(ranked)[1] if ranked else None

    def compile_merges(self) -> None:
        """The tables of B: each piece's last merge (-1: a character) and its rank, and the rank of each pair that can merge."""
        n, ids = len(self.texts), self.ids
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1.0] * n
        self.joins: dict[int, float] = {}
        seen: dict[float, int] = {}
        for text, i in ids.items():
            if len(text) == 1:
                continue
            seen[self.scores[i]] = seen.get(self.scores[i], 0) + 1
            self.rank[i] = -self.scores[i]
            for k in range(1, len(text)):
                if text[:k] in ids and text[k:] in ids:
                    self.joins[ids[text[:k]] * n + ids[text[k:]]] = -self.scores[i]
            parts = list(text)
            while len(parts) > 2:
                k = self.next_merge(parts)
                if k is None:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and all(p in ids for p in parts):
                self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
        reached = [i for t, i in ids.items() if len(t) > 1 and self.left[i] >= 0]
        self.by_merges = any(self.rank[i] < max(self.rank[self.left[i]], self.rank[self.right[i]]) for i in reached)
        #: Pieces whose rank is another's, too, or isn't above that of their parts: pairs with them are merged to see.
        self.odd = {i for t, i in ids.items() if len(t) > 1 and (seen[self.scores[i]] > 1 or self.left[i] < 0 or self.rank[i] <= max(self.rank[self.left[i]], self.rank[self.right[i]]))}
        for t, i in sorted(ids.items(), key=lambda x: len(x[0])):
            if len(t) > 1 and (self.left[i] in self.odd or self.right[i] in self.odd):
                self.odd.add(i)

    def may_follow(self, left: int, right: int) -> bool:
        """The arc of B from piece ``left`` to piece ``right``.

        Merges are undone from the last one back, on the right edge of ``left`` and the left edge of ``right``. The two pieces that stand
        at the edge between two undone merges would merge with each other if their pair ranks before the merge undone last, or, as the
        leftmost of equals goes first, as high as one undone on the right.
        """
        n = len(self.texts)
        key = left * n + right
        found = self.follows.get(key)
        if found is not None:
            return found
        if len(self.follows) >= REMEMBERED:
            self.follows.clear()
        if left in self.odd or right in self.odd:
            a, b = self.texts[left], self.texts[right]
            found = self.merged(a + b) == [a, b]
        else:
            joins, rank, x, y, before = self.joins, self.rank, left, right, float("inf")
            found = True
            while True:
                if joins.get(x * n + y, before) < before:
                    found = False
                    break
                if rank[x] >= rank[y]:
                    if rank[x] < 0:
                        break
                    before, x = rank[x], self.right[x]
                else:
                    before, y = min(before, math.nextafter(rank[y], math.inf)), self.left[y]
        self.follows[key] = found
        return found

    def normalise(self, text: str) -> str:
        if self.rules:
            text = self.rules.apply(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def shortest(self, chunk: str) -> list[int]:
        """The ids along the path of least weight through the composition with ``chunk``.

        Single-source shortest distances: all arcs out of a place are relaxed, first by weight, then by B, and places whose weight falls are
        taken again. Without B places are taken in order. With B the last one goes first: it has one finite path to each place, so the
        search ends when the end has a weight.
        """
        n, size, scores, trie = len(chunk), len(self.texts), self.scores, self.trie
        weight, back, last = [0.0] + [INFINITE] * n, [0] * (n + 1), [-1] * (n + 1)
        pairs = self.model_type == BPE
        known, check = self.follows.get, self.may_follow
        queue = [0] if pairs else list(range(n - 1, -1, -1))
        while queue and (weight[n] == INFINITE or not pairs):
            at = queue.pop()
            here, before = weight[at], last[at]
            left, node, end, alone = before * size, trie, at, False
            while node is not None and end < n:
                found = node.get(chunk[end])
                if found is None:
                    break
                end += 1
                piece, node = found
                if piece >= 0:
                    alone = alone or end == at + 1
                    total = here - scores[piece]
                    if total < weight[end]:
                        if pairs:
                            if before >= 0:  # a character of byte fallback merges with nothing
                                ok = known(left + piece)
                                if not (check(before, piece) if ok is None else ok):
                                    continue
                            queue.append(end)
                        weight[end], back[end], last[end] = total, at, piece
            if not alone:
                total = here + self.spelling(chunk[at])
                if total < weight[at + 1]:
                    weight[at + 1], back[at + 1], last[at + 1] = total, at, -1
                    if pairs:
                        queue.append(at + 1)
        if weight[n] == INFINITE:
            raise ValueError("no path: merges of equal rank decide here, which this machine does not cover")
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += reversed(self.spelled(chunk[back[at] : at]))
            at = back[at]
        out.reverse()
        return out

    def merge(self, chunk: str) -> list[int]:
        """The ids that the merges leave of ``chunk``, whatever their order: the best pair of neighbours first, the leftmost of equals."""
        parts: list[str | None] = list(chunk)
        before, behind = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if 0 <= k and behind[k] < len(parts) and (piece := self.ids.get(parts[k] + parts[behind[k]])) is not None:
                heappush(heap, (-self.scores[piece], k, parts[k] + parts[behind[k]]))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, k, text = heappop(heap)
            if parts[k] is None or behind[k] >= len(parts) or parts[k] + parts[behind[k]] != text:
                continue  # one of the two has been merged meanwhile
            gone = behind[k]
            parts[k], parts[gone], behind[k] = text, None, behind[gone]
            if behind[k] < len(parts):
                before[behind[k]] = k
            offer(before[k])
            offer(k)
        out: list[int] = []
        for text in parts:
            if text is not None:
                out += [self.ids[text]] if text in self.ids else self.spelled(text)
        return out

    def spelling(self, character: str) -> float:
        """The weight of byte fallback."""
        return self.fallback * len(character.encode("utf-8", "surrogatepass"))

    def spelled(self, text: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in text.encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; length of each)."""
        if len(self.known) >= REMEMBERED:
            self.forget()
        known = self.known
        chunks = [self.chunk.findall(normal) if self.split else [normal] for normal in map(self.normalise, texts)]
        every = list(chain.from_iterable(chunks))
        at = np.fromiter(map(known.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0).tolist()
        new = list(dict.fromkeys(map(every.__getitem__, missing)))
        if new:
            ids, ends = self.solve(new)
            known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            sizes = np.diff(ends)
            self.begin = np.r_[self.begin, len(self.flat) + ends[:-1]]
            self.size, self.flat, self.met = np.r_[self.size, sizes], np.r_[self.flat, np.array(ids, np.int32)], np.r_[self.met, np.zeros(len(new), np.int64)]
            at[missing] = [known[every[i]] for i in missing]
        self.met += np.bincount(at, minlength=len(self.met))
        flat = self.gather(at)
        upto = np.r_[0, np.cumsum(self.size[at])][np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))]
        long = [c for c in new if len(c) > LONGEST]
        for c in long:
            del known[c]
        if sum(map(len, long)) > REMEMBERED:  # their ids go with the next chunks that are forgotten, or now
            self.reset()
        return flat, np.diff(np.r_[0, upto])

    def solve(self, chunks: list[str]) -> tuple[list[int], np.ndarray]:
        """(ids of all chunks, one after the other; where each begins, and the end). What stands in no piece with its neighbour, as a full stop behind most
        words, is solved alone: the rest may be known."""
        one, known, together = self.merge if self.by_merges else self.shortest, self.known, self.together
        ids: list[int] = []
        ends = [0]
        for c in chunks:
            if len(c) > 1 and c[-2:] not in together:
                stem = known.get(c[:-1])
                if stem is None:
                    ids += one(c[:-1])
                else:
                    begin = self.begin[stem]
                    ids += self.flat[begin : begin + self.size[stem]].tolist()
                c = c[-1]
            ids += one(c)
            ends.append(len(ids))
        return ids, np.array(ends, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that N put in front is taken away again."""
        data = b"".join(map(self.out.__getitem__, ids))
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The machines of ``path``, compiled once in a worker."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row. The file must lie at ``model`` on each machine."""
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                flat, sizes = machine.encode_all([t or "" for t in rows.column("t").to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([rows.column("k"), ids], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(of, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(key, text) of each row; null ids give an empty text."""
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [machine.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("ids")).mapInArrow(of, f"k {kind}, text string").withColumnRenamed("k", key)


def encoded(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """The query's columns: doc_id, n_tokens, ids_crc32 (ids as little-endian 32-bit integers), and whether decoding the ids gives the text
    back; ``with_ids`` adds ``ids`` and ``text``, what they decode to."""
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                given = [t or "" for t in rows.column("text").to_pylist()]
                flat, sizes = machine.encode_all(given)
                ends = np.r_[0, np.cumsum(sizes)]
                each = [flat[b:e] for b, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                texts = [machine.decode(ids.tolist()) for ids in each]
                columns = [rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(ids) for ids in each], pa.int64()), pa.array([a == b for a, b in zip(given, texts)], pa.bool_())]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", *(["ids", "text"] if with_ids else [])]
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>, text string" if with_ids else ""))
