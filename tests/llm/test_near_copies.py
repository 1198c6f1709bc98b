"""The pipeline's stage near_dedup: recall of near copies of any length."""

import random

import pytest

from fitloom.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def changed(rng, w, times):
    out = list(w)
    for i in rng.sample(range(5, len(w) - 5), times):
        out[i] = "new"
    return out


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("length", "times"), [(55, 1), (80, 1), (150, 3)])
def test_near_copies_of_short_texts_meet(docs, length, times):
    rng = random.Random(length)
    rows = []
    for i in range(40):
        w = words(rng, length)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed(rng, w, times)))]
    assert all(jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8 for i in range(40))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()) == list(range(0, 80, 2))


def test_half_alike_long_texts_stay(docs):
    """Texts that share a block and little else, at similarities of 0.43 to 0.6."""
    rng = random.Random(4)
    rows = []
    for i, (n, share) in enumerate([(10_000, 0.7), (10_000, 0.6), (10_000, 0.75), (3_000, 0.7), (3_000, 0.75), (300, 0.75)]):
        block = words(rng, int(n * share))
        rows += [(2 * i + k, " ".join(block + words(rng, n - len(block)))) for k in (0, 1)]
        assert jaccard(rows[-1][1], rows[-2][1]) < 0.61
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()) == list(range(len(rows)))


def test_components_are_those_of_the_exact_similarity(docs):
    """Families of copies of copies around 0.8, one of them above ``PAIRS``."""
    rng = random.Random(8)
    texts = []
    for size, length in [(80, 120), (12, 60), (8, 400), (8, 30)]:
        base = words(rng, length)
        texts += [" ".join(changed(rng, base, rng.randint(0, max(1, length // 45)))) for _ in range(size)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {find(i) for i in range(len(texts))}
    assert 4 <= len(least) < len(texts)
    assert {r["doc_id"] for r in simhash.one_of_each(docs(list(enumerate(texts)))).collect()} == least


@pytest.mark.parametrize(("size", "length", "share"), [(800, 120, 0.62), (1500, 120, 0.62), (1500, 300, 0.7)])
def test_pairs_in_large_groups_are_found(size, length, share):
    """Very many texts share a passage, so groups of a class are far above 33; near copies that hide among them meet all the same."""
    import numpy as np

    rng = random.Random(size + length)
    passage, texts, planted = words(rng, int(length * share)), [], []
    for i in range(size):
        own = passage + words(rng, length - len(passage))
        texts.append(own)
        if i % 15 == 0:
            planted.append((len(texts) - 1, len(texts)))
            texts.append(changed(rng, own, rng.randint(1, max(1, length // 55))))
    assert all(jaccard(" ".join(texts[a]), " ".join(texts[b])) >= 0.8 for a, b in planted) and jaccard(" ".join(texts[0]), " ".join(texts[2])) < 0.75
    prints = [simhash.class_prints(simhash.shingle_hashes(" ".join(t).encode(), 5)) for t in texts]
    times = [len(k) for k, _, _ in prints]
    keys = np.concatenate([k for k, _, _ in prints]).view(np.int64)
    fps, sizes, nodes = (np.repeat(np.array(x), times) for x in ([f for _, f, _ in prints], [n for _, _, n in prints], range(len(texts))))
    order = simhash.turned(fps.astype(np.uint64), keys)
    at = np.lexsort((order.view(np.int64), keys))
    u, v = simhash.near_pairs(keys[at], order[at], sizes[at].astype(np.int32), nodes[at].astype(np.int64))
    assert max(np.unique(keys, return_counts=True)[1]) > 300
    met = set(zip(u.tolist(), v.tolist()))
    lost = [p for p in planted if p not in met]
    print(f"{len(planted) - len(lost)} of {len(planted)} pairs met, {len(met)} candidates of {len(texts)} texts")
    assert len(lost) <= 0.02 * len(planted)
