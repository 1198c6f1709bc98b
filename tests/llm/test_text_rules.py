"""Quality rules, line windows, decontamination: native operators against small brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fitloom.llm import decontaminate, line_dedup, quality

CLEAN = "The river went down to the town and the mill stood by the road.\n" * 1


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w = words(t)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_counts(docs):
    rng = random.Random(0)
    texts = [None, "", " \n\t", "a b c a b c", "x " * 3000, "é\u2003b c\nd e\nd e\n \n", "# a | b\n" * 40, "word " * 2 + "q\x0bw\x85e"] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 80))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three"), (3, "a b c a b c")]
    out = quality.judged(docs(rows)).collect()
    assert len(out) == len(rows)
    expected = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == expected
    assert not any(r["kept"] for r in out if r["base_failed"])


def test_quality_keeps_prose_and_drops_junk(docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(10))
    junk = {"caps": " ".join(word().upper() + "!!" for _ in range(100)), "bars": " | ".join(word() for _ in range(100)), "signs": " ".join(word() + "***" for _ in range(100)), "open": "\n".join(" ".join(word() for _ in range(9)) for _ in range(12))}
    rows = [(0, prose), (1, prose + "\nHome | About | Contact\nAll rights reserved.")] + [(i, t) for i, t in enumerate(junk.values(), 2)]
    out = {r["doc_id"]: r for r in quality.quality_rules(docs(rows)).select("doc_id", F.col("quality_rules__.kept").alias("kept"), F.col("quality_rules__.clean_text").alias("clean")).collect()}
    assert [out[i]["kept"] for i in range(6)] == [True, True, False, False, False, False]
    assert out[0]["clean"] == prose and out[1]["clean"] == prose


def line_brute(rows):
    seen, gone = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        cut = set()
        for a in range(len(at) - 2):
            w = tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in at[a : a + 3])
            if w in seen:
                cut |= set(at[a : a + 3])
            seen.add(w)
        gone[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)
    return gone


def test_line_windows(docs):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", " c ", "", "\t"]) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(100, None), (101, ""), (None, "a\nb\nc\na"), (0, "x\ny\nz"), (7, "q\nq\nq\nq\nq\nq")]
    rows += [rows[3]]
    expected = line_brute([(d, t) for d, t in rows if (d, t) != (0, "x\ny\nz")] + [(0, "x\ny\nz")])
    out = line_dedup.deduped(docs(rows)).collect()
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in out) == Counter((d, expected[d, t][1], expected[d, t][2], hashlib.sha256(expected[d, t][0].encode()).hexdigest()) for d, t in rows)


def test_line_dedup_carries_columns(docs):
    df = docs([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)])
    out = line_dedup.line_dedup(df)
    assert out.columns[: len(df.columns)] == df.columns
    rows = {r["doc_id"]: r["kept_text_"] for r in out.collect()}
    assert rows == {1: "a\nb\nc", 2: "d", 3: None}


def leak_brute(rows, items):
    out = {}
    for d, t in rows:
        w = words((t or "").lower())
        for i, text in items:
            iw = words((text or "").lower())
            m, it = len(iw), Counter(tuple(iw[k : k + 5]) for k in range(len(iw) - 4))
            if not it:
                continue
            for s in range(len(w) - m + 1):
                win = Counter(tuple(w[k : k + 5]) for k in range(s, s + m - 4))
                both = sum((win & it).values())
                sim = both / (2 * sum(it.values()) - both)
                if sim >= 0.8:
                    out[d, i] = max(sim, out.get((d, i), 0))
    return out


def test_leaks(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(12)] + [(20, None), (21, "one two"), (22, "da " * 12)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            leak = words(items[i % 12][1])
            for _ in range(i % 4):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in leak]
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (None, items[3][1]), (1002, "da " * 30), (1, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaked(docs(rows), bench).collect()}
    expected = leak_brute(rows, items)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got) and len(got) > 8
    kept = decontaminate.decontaminate(docs(rows), bench)
    bad = {d for d, _ in expected}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad)


@pytest.mark.parametrize("op", [quality.judged, line_dedup.deduped])
def test_empty_table(docs, op):
    assert op(docs([])).count() == 0


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaked(docs([(1, "a b c d e f")]), none).count() == 0
    assert decontaminate.leaked(docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert decontaminate.decontaminate(docs([(1, "a b c d e f"), (None, None)]), none).count() == 2


def test_native_plans(spark, docs):
    for df in (quality.judged(docs([(1, "a")])), line_dedup.deduped(docs([(1, "a")])), decontaminate.leaked(docs([(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
