"""Suffix dedup and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fitloom.llm import simhash, suffix_dedup
from fitloom.llm.components import components


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_difference_cover(q):
    v, d = suffix_dedup.difference_cover(q)
    assert v == q * q + q + 1 and len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


def cut_brute(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest(), kept if gone.any() else None))
    return out


def passages(seed, n):
    """Texts with shared, shifted, overlapping and periodic passages around the length."""
    rng = random.Random(seed)
    text = lambda k, letters="abcdefghij é": "".join(rng.choice(letters) for _ in range(k))
    pool = [text(rng.randint(n - 5, 3 * n)) for _ in range(6)] + ["ab" * n, "z" * (n + 3)]
    out = [None, "", "short", text(n - 1), "z" * (2 * n), "ab" * n + "a"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            parts += [text(rng.randint(0, n)), rng.choice([p, p, p[a:b]])]
        out.append("".join(parts))
    return out + [out[7], out[9], out[9]]


@pytest.mark.parametrize(("seed", "n", "coarse", "fine", "wide"), [(0, 40, 5, 2, False), (1, 40, 3, 2, True), (2, 30, 3, 3, False), (3, 400, 17, 7, False)])
def test_suffix_dedup(docs, seed, n, coarse, fine, wide):
    texts = passages(seed, n)
    rows = [(i if i != 8 else None, t) for i, t in enumerate(texts)]
    expected = cut_brute(texts, n)
    out = suffix_dedup.deduped(docs(rows), n, coarse, fine, wide, with_text=True).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], None if r["kept"] is None else bytes(r["kept"])) for r in out)
    assert got == Counter((d, *e) for (d, _), e in zip(rows, expected))


def test_long_texts_are_hashed_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    data = np.random.default_rng(0).integers(0, 256, 20_000).astype(np.uint8)
    at = np.arange(0, 19_000, 7)
    small = suffix_dedup.Hasher(3, 64).windows(data, at, 64)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    assert np.array_equal(small, suffix_dedup.Hasher(3, 64).windows(data, at, 64))
    twin = np.concatenate([data, data])
    assert np.array_equal(small, suffix_dedup.Hasher(3, 64).windows(twin, at + 20_000, 64)) and len(set(small.tolist())) == len(small)


def test_suffix_dedup_of_nothing(docs):
    assert suffix_dedup.deduped(docs([])).count() == 0
    assert [r["n_removed"] for r in suffix_dedup.deduped(docs([(1, "a"), (2, None)])).collect()] == [0, 0]


def print_brute(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghÉX") for _ in range(rng.randint(1, 6)))
    out = [None, "", "  \n", "one", "One", "one two three", "a b c d", "A B C D"]
    for _ in range(12):
        w = [word() for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 8)):
            c = list(w)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = word()
            out.append(" ".join(c))
    return out + [out[9], out[9]]


@pytest.mark.parametrize("seed", [0, 1])
def test_simhash_groups(docs, seed):
    texts = near_texts(seed)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in simhash.grouped(docs(rows)).collect()}
    fp = {d: print_brute(t, 4) for d, t in rows}
    assert {d: int(r["fingerprint"], 16) for d, r in out.items()} == fp
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {d: r["component_id"] for d, r in out.items()} == {d: find(d) for d in fp} and len({find(d) for d in fp}) < len(fp)


@pytest.mark.parametrize("ring", [simhash.WHOLE, simhash.Ring(2, (22, 21, 21), 1), simhash.Ring(4, (11, 11, 11, 11, 10, 10), 2)])
@pytest.mark.parametrize("large", [2, 1000])
def test_ring_loses_no_pair(ring, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in list(fps):
        for bits in range(1, ring.radius + 2):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    fps = np.unique(np.array(fps, np.uint64))
    keys, rows, plain = [], [], []
    for k, p in ring.keys(fps):
        keys.append(k)
        rows.append(fps)
        plain.append(np.full(len(fps), p))
    keys, rows, plain = (np.concatenate(x) for x in (keys, rows, plain))
    order = np.argsort(keys, kind="stable")
    u, v = simhash.pair_up(ring, keys[order], rows[order], rows[order], plain[order])
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= ring.radius]]
    label = lambda pairs: classes(fps, pairs)
    assert label(list(zip(u, v))) == label(near) and len(near) >= 60


def classes(nodes, pairs):
    root = {int(n): int(n) for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return {n: find(n) for n in root}


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + k) for k in range(1, 40)] + [(-5, 2), (7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    expected = classes({n for e in real for n in e}, real)
    assert out == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(docs):
    rng = random.Random(9)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    other = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    changed = list(w)
    for i in (50, 200, 333):
        changed[i] = "new"
    rows = [(5, " ".join(w)), (3, " ".join(changed)), (9, " ".join(w)), (4, " ".join(other)), (4, " ".join(other)), (7, None), (8, ""), (None, " ".join(w + ["end"]))]
    out = simhash.one_of_each(docs(rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 4, 7] and out.columns == docs(rows).columns
    assert simhash.one_of_each(docs([])).count() == 0 and simhash.grouped(docs([])).count() == 0
