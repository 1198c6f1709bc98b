"""Operator 13 against dense counts in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fitloom.llm import source_audit

KIND = "doc_id long, text string, lang string, source string"


def brute(rows):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        documents = Counter(t for x in terms if x[0] == lang for t in set(x[2]))
        kept = sorted(t for t, n in documents.items() if n >= 3)
        groups = defaultdict(Counter)
        for own, source, words in terms:
            if own == lang:
                groups[source].update(w for w in words if documents[w] >= 3)
        total = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            best = [(-f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else 200]
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in source_audit.audited(df).collect())


def made(n, seed, vocabulary=900, most=60, decay=0.01):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ漢") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    rows = []
    for i in range(n):
        shift = rng.randint(0, 7)
        text = rng.choice([" ", "\n", "1", "-", "\x7f"]).join(w if rng.random() < 0.8 else w.upper() for w in (words[min(vocabulary - 1, int(rng.expovariate(decay)) + 3 * shift)] for _ in range(rng.randint(0, most))))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, ""]), "s0" if rng.random() < 0.35 else rng.choice(["s1", "s2", f"s{shift}", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_is_the_dense_count(spark, seed):
    rows = made(500, seed, 3000, 150, 0.0015)
    want = brute(rows)
    assert found(spark.createDataFrame(rows, KIND)) == want
    assert any(r[2] == "term" and r[5] == 200 for r in want)  # the cut at 200 has been met


def test_small_memory(spark, monkeypatch):
    """Tasks that put out after each few terms and cells."""
    rows = made(200, 3)
    for name, value in (("COUNTED", 50), ("CELLS", 30), ("AT_ONCE", 64), ("PIECE", 16), ("MOST_GROUPS", 0)):
        monkeypatch.setattr(source_audit, name, value)
    assert found(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, "", "", "a"), (2, "one one", "en", "a"), (2, "one one", "en", "a"), (3, "ONE two", "en", "b"), (4, "1 2 3", "en", "c"), (5, "alone", "fr", "a"), (5, "x", "fr", "b"), (None, "one", "en", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", term string, n int")
    assert found(df) == brute(rows)


def test_of_nothing(spark):
    assert found(spark.createDataFrame([], KIND)) == []


def test_a_long_text(spark):
    text = "word " * 3_000_000 + "x" * 9_000_000 + " end"
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([(text, "a"), ("word end", "b"), ("word end", "b"), ("end", "a")])]
    assert found(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_terms_in_pieces(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 8)
    text = "Ab cd,ef-ghijklmnopqrstuv wx É é漢字 1y"
    assert [t.decode() for some in source_audit.terms_of(text.encode()) for t in some] == ["ab", "cd", "ef", "ghijklmnopqrstuv", "wx", "É", "é漢字", "y"]


def test_shares_of_large_counts(spark):
    rng = random.Random(1)
    pairs = [(c := rng.randint(0, 10 ** rng.randint(1, 15)), c + rng.randint(1, 10 ** rng.randint(1, 15))) for _ in range(300)] + [(0, 1), (9 * 10**15 - 1, 9 * 10**15)]
    want = [1 + 10**9 * (c + 1) // n for c, n in pairs]
    assert source_audit.shares(np.array([c for c, _ in pairs]), np.array([n for _, n in pairs])).tolist() == want
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c long, n long")
    from pyspark.sql import functions as F

    assert [r["p"] for r in df.select("i", source_audit.share(F.col("c"), F.col("n")).alias("p")).orderBy("i").collect()] == want
