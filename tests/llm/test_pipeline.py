"""Every stage of the pipeline against brute force on all documents of sf0.001, and the recall of near copies on those of sf0.1."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

import corpus_pipeline
from fitloom.llm import decontaminate, pieces, quality, simhash
from fitloom.llm.common import text_key

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def line_fails(line):
    n, chars = len(words(line)), sum(map(len, words(line)))
    symbols, marks = len(re.findall(quality.SYMBOLS, line)), len(re.findall(quality.NAVIGATION, line))
    letters, capitals = len(regex.findall(r"\p{L}", line)), len(regex.findall(r"\p{Lu}", line))
    closed = re.search(r"""[.!?…:;。！？]["'”’»)\]]*(?:[ \t-\r]|$)""", line)
    return symbols > 0.1 * chars or marks >= 3 and n <= 4 * (marks + 1) or n >= 5 and capitals > 0.6 * letters or n >= 3 and not closed or any(p in line.lower() for p in quality.BOILERPLATE)


def brute_quality(rows):
    out = []
    for d, text in rows:
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        clean = [x for x in lines if not line_fails(x)]
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and sum(map(len, clean)) >= 0.5 * sum(map(len, lines)):
            out.append((d, "\n".join(clean)))
    return out


def brute_lines(rows):
    first, found = {}, defaultdict(set)
    for d, text in sorted(rows):
        at = [(i, x.strip(SPACE)) for i, x in enumerate(text.split("\n")) if words(x)]
        for k in range(len(at) - 2):
            window = tuple(x for _, x in at[k : k + 3])
            if first.setdefault(window, (d, k)) != (d, k):
                found[d] |= {i for i, _ in at[k : k + 3]}
    out = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in found[d]), bool(found[d])) for d, t in rows]
    return [(d, t) for d, t, cut in out if not cut or words(t)]


def shingles(text, low):
    w = [x.decode() for x in low(text or "").encode().split()]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)], w


def near_pairs(rows):
    """(i, j, similarity) of all pairs of 0.8 or more: of any fifth of a set and one more, a pair has a shingle in common, so the rarest do."""
    low = lambda t: t.encode().lower().decode()
    sets = []
    for _, t in rows:
        s, w = shingles(t, low)
        sets.append(set(s) if s else {tuple(w)})
    times = Counter(x for s in sets for x in s)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (times[x], x))[: len(s) // 5 + 1]:
            holders[x].append(i)
    out = []
    for i, j in {(i, j) for h in holders.values() for a, i in enumerate(h) for j in h[a + 1 :]}:
        c = len(sets[i] & sets[j])
        if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
            out.append((i, j, c / (len(sets[i]) + len(sets[j]) - c)))
    return out


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, *_ in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def brute_near(rows):
    rows = sorted(rows)
    return [rows[i] for i, r in enumerate(roots(len(rows), near_pairs(rows))) if r == i]


def brute_leaks(rows, items):
    low = str.lower
    bench = [(i, *shingles(t, low)) for i, t in items]
    out = {}
    for d, text in rows:
        sh, w = shingles(text, low)
        have = set(sh)
        for i, item, iw in bench:
            if not have.intersection(item):
                continue
            m, total = len(iw), Counter(item)
            for start in range(max(1, len(w) - m + 1)):
                window = Counter(sh[start : start + m - 4])
                both = sum((window & total).values())
                alike = both / (sum(window.values()) + len(item) - both)
                if alike >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), alike)
    return out


def test_each_stage_is_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    brute = {
        "quality_rules": brute_quality, "line_dedup": brute_lines, "near_dedup": brute_near,
        "decontamination": lambda rows: [r for r in rows if r[0] not in {d for d, _ in brute_leaks(rows, items)}],
    }
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        found = out.collect()
        before, rows = len(rows), brute[name](rows)
        assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(rows), name
        assert len(rows) < before or name == "line_dedup"
        docs = spark.createDataFrame(found, out.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert last.keys() == {d for d, _ in rows}
    for d, t in rows:
        ids = library.encode(t)
        assert last[d]["ids"] == ids and last[d]["text"] == t and last[d]["n_tokens"] == len(ids) and last[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and last[d]["round_trip"]
    final = {r["doc_id"]: r["ids_crc32"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == {d: r["ids_crc32"] for d, r in last.items()}


def test_run_leaves_its_result_only(spark):
    from fitloom.llm import common

    mark = common.made()
    out = corpus_pipeline.run(spark, SF)
    assert common.made() == mark + 1 and out.count() > 0 and common.clean(spark, mark) == 1


def test_recall_of_near_copies_on_all_documents(spark):
    """At least nine in ten of all pairs of 0.8 and more, copies aside, in every band; no two documents without a chain of such pairs."""
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    distinct = list({t or "": (d, t or "") for d, t in reversed(rows)}.values())
    docs = spark.createDataFrame(distinct, "id long, text string").select("id", text_key_column("text").alias("key"), text_key_column("text", 1).alias("key2"), "text")
    root = {r["id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    pairs = near_pairs(distinct)
    found = [root[distinct[i][0]] == root[distinct[j][0]] for i, j, _ in pairs]
    bands = [[f for f, (_, _, s) in zip(found, pairs) if lo <= s < hi] for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01))]
    assert len(pairs) >= 30 and all(np.mean(b) >= 0.9 for b in bands if b)
    true = roots(len(distinct), pairs)
    groups = defaultdict(set)
    for i, (d, _) in enumerate(distinct):
        groups[root[d]].add(true[i])
    assert all(len(g) == 1 for g in groups.values())


def text_key_column(name, seed=None):
    from pyspark.sql import functions as F

    return text_key(F.col(name), seed)


def test_texts_that_clash_in_a_key_stay_apart(spark, docs, monkeypatch):
    """With keys of two bits nearly all texts clash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "text_key", lambda text, seed=None: F.pmod(text_key(text), F.lit(4)) if seed is None else text_key(text, seed))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(40)]
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()) == list(range(40))


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_at_the_edge_are_found(spark, docs, seed):
    """Windows that share 0.80 to 0.83 with an item: the radius of the fingerprints loses none."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, rows = [], []
    for i in range(120):
        m = rng.randint(13, 59)
        w = [word() for _ in range(m)]
        items.append((i, " ".join(w)))
        lost = (m - 4) // 9  # shingles that may be lost: cut them from the ends, or by a word changed inside
        text = list(w)
        if lost >= 5 and rng.random() < 0.5:
            text[rng.randrange(5, m - 5)] = word()
            lost -= 5
        front = rng.randint(0, lost)
        text[:front] = [word() for _ in range(front)]
        text[m - (lost - front) :] = [word() for _ in range(lost - front)]
        rows.append((i, " ".join([word() for _ in range(30)] + text + [word() for _ in range(30)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaked(docs(rows), bench).collect()}
    expected = brute_leaks(rows, items)
    assert got.keys() == expected.keys() and len(got) == 120 and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())
    assert sum(v < 0.83 for v in expected.values()) > 60
