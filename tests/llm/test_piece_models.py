"""Operator 7 on models made here, against the library and against merges one by one."""

import random
import struct

import pytest
import sentencepiece

from fitloom.llm import pieces
from fitloom.llm.pieces import BPE, BYTE, MARK, NORMAL, UNIGRAM, UNKNOWN, Transducer


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(folder, scored, kind, charsmap=b"", fallback=True):
    """A model file of (piece, score): <unk>, bytes, then the pieces."""
    rows = [("<unk>", 0.0, UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256) if fallback] + [(t, s, NORMAL) for t, s in scored]
    body = b"".join(field(1, field(1, t.encode()) + field(2, float(s)) + (field(3, k) if k != NORMAL else b"")) for t, s, k in rows)
    trainer = field(3, kind) + (field(35, 1) if fallback else b"")
    normal = field(1, b"own") + (field(2, charsmap) if charsmap else b"") + field(3, 1) + field(4, 1) + field(5, 1)
    path = folder / f"{len(list(folder.iterdir()))}.model"
    path.write_bytes(body + field(2, trainer) + field(3, normal))
    return str(path)


def rules_blob(rules):
    """The normaliser's table: a double array of the left sides, then the right sides. Each node's children have 256 places of their own."""
    trie, texts, places = {}, b"", {}
    for left, right in rules.items():
        node = trie
        for b in left.encode():
            node = node.setdefault(b, {})
        node[None] = len(texts)
        texts += right.encode() + b"\0"
    units = {}

    def lay(node, at, label):
        base = 256 * (len(places) + 1)
        places[id(node)] = base
        units[at] = (at ^ base) << 10 | (256 if None in node else 0) | label
        if None in node:
            units[base] = 1 << 31 | node[None]
        for b, child in node.items():
            if b is not None:
                lay(child, base ^ b, b)

    lay(trie, 0, 0)
    array = [units.get(i, 0xFF) for i in range(256 * (len(places) + 2))]
    blob = struct.pack(f"<{len(array)}I", *array)
    return struct.pack("<I", len(blob)) + blob + texts


def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def alike(machine, a, b):
    """The same ids, or another path of the same text and weight."""
    return a == b or machine.decode(a) == machine.decode(b) and abs(sum(machine.scores[i] for i in a) - sum(machine.scores[i] for i in b)) < 1e-3


def made_text(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_unigram_models(tmp_path, seed):
    """The shortest path by log probabilities; texts of the same ids, or of the same weight where two paths are equal."""
    rng = random.Random(seed)
    texts = {MARK, *"abcd"} | {made_text(rng, "abcd" + MARK, rng.randint(1, 5)).replace(MARK, "", 0) for _ in range(60)}
    texts = {t for t in texts if MARK not in t[1:]}
    path = model(tmp_path, [(t, -rng.uniform(1, 12)) for t in sorted(texts)], UNIGRAM)
    ours, theirs = Transducer(path), library(path)
    for _ in range(300):
        text = made_text(rng, "aabbccdd é", rng.randint(0, 40))
        assert alike(ours, ours.encode(text), theirs.encode(text)), text


def ranked(rng, order):
    """A vocabulary of merges; with ``order`` each piece ranks behind two that make it up."""
    known = list("abc") + [MARK]
    while len(known) < 40:
        new = rng.choice(known) + rng.choice(known)
        if new not in known and len(new) < 9 and MARK not in new[1:]:
            known.append(new)
    merges = known[4:]
    if not order:
        rng.shuffle(merges)
    return [(t, -1000.0) for t in known[:4]] + [(t, -float(i)) for i, t in enumerate(merges)]


@pytest.mark.parametrize("order", [True, False])
def test_byte_pair_models(tmp_path, order):
    """Models in order of rank by the search, others by their merges: both as if merged one by one."""
    rng, looked_at = random.Random(7), 0
    for _ in range(60):
        path = model(tmp_path, ranked(rng, order), BPE)
        ours, theirs = Transducer(path), library(path)
        if ours.by_merges == order or looked_at == 20:
            continue
        looked_at += 1
        for _ in range(120):
            text = made_text(rng, "aaabbc ", rng.randint(0, 25))
            expected = [i for p in ours.merged(ours.normalise(text)) for i in ([ours.ids[p]] if p in ours.ids else ours.spelled(p))]
            assert ours.encode(text) == expected == theirs.encode(text), text
    assert looked_at >= 10


def test_rules(tmp_path):
    """Normaliser rules, one of over 64 bytes, the longest that fits first."""
    long = "x" * 70 + "y"
    blob = rules_blob({"é": "e", "ab": "ba", "abc": "c", "Ａ": "a", long: "b", "\t": " "})
    path = model(tmp_path, [(MARK, -1.0)] + [(c, -2.0) for c in "abcexy"] + [("ba", -1.5), ("ea", -1.2), (MARK + "b", -1.1)], UNIGRAM, blob)
    ours, theirs = Transducer(path), library(path)
    assert ours.normalise("é" + long + "\tabcab") == f"{MARK}eb{MARK}cba"
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["é", "a", "b", "c", "ab", "abc", "Ａ", " ", "\t", long, long[:-1], "x"]) for _ in range(rng.randint(0, 12)))
        assert alike(ours, ours.encode(text), theirs.encode(text)), text


def test_what_is_remembered_changes_nothing(monkeypatch):
    """Few chunks are remembered, so that they are forgotten and solved again all the time."""
    rng = random.Random(3)
    words = [made_text(rng, "aeioustrnl", rng.randint(1, 9)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) + rng.choice([".", "!\n", "  ", "…", "x" * 90]) for _ in range(120)]
    whole = Transducer(pieces.default_model())
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    small = Transducer(pieces.default_model())
    got = []
    for i in range(0, len(texts), 7):
        flat, sizes = small.encode_all(texts[i : i + 7])
        at = 0
        for n in sizes.tolist():
            got.append(flat[at : at + n].tolist())
            at += n
    assert got == want == library(pieces.default_model()).encode(texts)
    assert small.encode("") == [] and small.encode_all([])[0].tolist() == []
