"""Decontamination at the edges: documents shorter than an item."""

import random

from fitloom.llm import decontaminate


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def bench(spark, items):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")


def test_documents_shorter_than_the_item(spark, docs):
    rng = random.Random(2)
    items = [words(rng, n) for n in (9, 14, 29, 50, 54) for _ in range(8)]
    rows, expected = [], {}
    for i, w in enumerate(items):
        size = len(w) - 4
        most, middle = size // 5, len(w) // 2
        edge = [*w[: middle - 1], "new", *w[middle:-1]]
        for k, text in enumerate((w[:-1], w[1:], w[:-most], w[most:], w[: -most - 1], edge)):
            rows.append((10 * i + k, " ".join(text)))
            sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (text, w)]
            alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            if alike >= 0.8:
                expected[10 * i + k, i] = alike
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaked(docs(rows), bench(spark, items)).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    kept = decontaminate.decontaminate(docs(rows), bench(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in expected}


def test_windows_of_exactly_the_similarity(spark, docs):
    """Items of 9 and 18 shingles that lack one and two at their edges: 8 / 10 and 16 / 20."""
    rng = random.Random(6)
    items = [words(rng, n) for n in (13, 22) for _ in range(40)]
    rows = []
    for i, w in enumerate(items):
        for k, (a, b) in enumerate([(1, 0), (0, 1)] if len(w) == 13 else [(1, 1), (2, 0), (0, 2)]):
            text = words(rng, 20) + words(rng, a) + w[a : len(w) - b] + words(rng, b) + words(rng, 20)
            rows.append((10 * i + k, " ".join(text)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaked(docs(rows), bench(spark, items)).collect()}
    assert got == {(d, d // 10): 0.8 for d, _ in rows}
