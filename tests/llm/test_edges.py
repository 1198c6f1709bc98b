"""Names that clash with inner ones, nulls, repeated rows and very long texts, for each operator and stage."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from fitloom.llm import decontaminate, line_dedup, pieces, quality, registry, secret_scan, simhash, suffix_dedup, token_store, toxicity, url_filter

NAMES = [
    "a.b", "a`b", "id", "key", "key2", "k", "t", "item", "item_id", "start", "sh", "fp", "h", "m", "hits", "root", "clash", "node", "u", "v", "line_key_", "found_id_", "found_key_", "found_pos_", "line_kept_", "kept_text_", "n_lines_", "n_removed_",
    "near_key_", "near_key2_", "near_nth_", "keep_id_", "keep_key_", "keep_key2_", "leak_key_", "leak_id_", "leak_doc_key_", "quality_rules_", "quality_raw_", "copies", "n_bytes", "spans", "score", "n_chars",
]
PASSAGE = "One line of it is here. \nA second line comes after it.\nAnd a third one ends the passage."


def crowded(spark, rows):
    """``rows`` (doc_id, text) in the midst of columns whose names are those of inner ones."""
    kinds = ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'n_chars' else 'string'}" for n in NAMES)
    data = [(*(None if n == "n_chars" else f"{n} of {i}" for n in NAMES[:5]), d, t, *(7 if n == "n_chars" else f"{n} of {i}" for n in NAMES[5:])) for i, (d, t) in enumerate(rows)]
    first = ", ".join(kinds.split(", ")[:5])
    rest = ", ".join(kinds.split(", ")[5:])
    return spark.createDataFrame(data, f"{first}, doc_id long, text string, {rest}")


def sample_rows():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    body = [words(90) + "." for _ in range(4)]
    return [(1, f"{PASSAGE}\n{body[0]}"), (2, f"{body[1]}\n{PASSAGE}"), (3, body[2]), (4, body[2]), (4, body[2]), (5, None), (6, ""), (None, body[3]), (None, body[3]), (None, None)]


OPERATORS = {
    "quality_rules": lambda df: quality.quality_rules(df), "line_dedup": lambda df: line_dedup.line_dedup(df), "one_of_each": lambda df: simhash.one_of_each(df), "grouped": lambda df: simhash.grouped(df), "deduped": lambda df: suffix_dedup.deduped(df),
    "secret_scan": lambda df: secret_scan.secret_scan(df), "encode": lambda df: pieces.encode(df), "encoded": lambda df: pieces.encoded(df, with_ids=True), "stored": lambda df: token_store.stored(df),
    "decontaminate": lambda df: decontaminate.decontaminate(df, df.sparkSession.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")),
    "toxicity": lambda df: toxicity.scored(df, df.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_that_clash(spark, name):
    """Each row comes through (of one_of_each one a group), with the values of its other columns."""
    rows = sample_rows()
    df = crowded(spark, rows)
    out = OPERATORS[name](df).collect()
    assert len(out) == (5 if name == "one_of_each" else len(rows))
    if name in ("quality_rules", "line_dedup", "one_of_each", "decontaminate"):
        for r in out:
            values = r.asDict()
            assert values["a.b"].startswith("a.b of") if values["a.b"] else True
            assert all(v is None or n == "n_chars" or str(v) == f"{n} of {values['fp'].split(' of ')[1]}" for n, v in values.items() if n in NAMES)


def test_stages_with_names_that_clash(spark, tmp_path):
    docs = crowded(spark, sample_rows())
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or name == "near_dedup"
    ids = sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, None]


@pytest.fixture(scope="module")
def long_text():
    """Ten megabytes of sentences in lines, without repeats."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    words = [bytes(letters[x]).decode() for x in rng.integers(0, 26, (1_430_000, 6))]
    return "\n".join(" ".join(words[i : i + 13]) + "." for i in range(0, len(words), 13))


def test_long_texts(spark, long_text):
    assert len(long_text) > 10_000_000
    docs = spark.createDataFrame([(1, long_text), (2, "short text"), (3, long_text[:5_000_000] + "# token=abcdefgh")], "doc_id long, text string")
    n = len(long_text.split())
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    judged = by(quality.judged(docs))
    assert judged[1]["n_words"] == n and judged[1]["kept"] and judged[1]["n_repeat_words"] < 100
    cut = by(line_dedup.deduped(docs))
    lines = long_text[:5_000_000].count("\n")
    assert cut[1]["n_removed"] == 0 and lines - 1 <= cut[3]["n_removed"] <= lines
    gone = by(suffix_dedup.deduped(docs))
    assert gone[1]["n_removed"] == 5_000_000 == gone[3]["n_removed"] and gone[3]["n_spans"] == 1
    prints = by(simhash.grouped(docs))
    assert prints[1]["component_id"] == 1 and len(prints) == 3
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [1, 2, 3]
    assert by(secret_scan.scanned(docs))[3]["spans"] == "assign:5000002:5000016"
    coded = by(pieces.encoded(docs))
    assert coded[1]["round_trip"] and coded[1]["n_tokens"] > n
    stored = by(token_store.stored(docs))
    assert stored[1]["start"] == 0 and stored[2]["start"] == stored[1]["n_tokens"]
    items = spark.createDataFrame([(9, " ".join(long_text[7_000_000:7_000_400].split()[1:-1]))], "item_id long, text string")
    assert [(r["doc_id"], r["similarity"]) for r in decontaminate.leaked(docs, items).collect()] == [(1, 1.0)]
    assert len(by(toxicity.scored(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")))) == 3


def test_stages_keep_a_long_text(spark, long_text, tmp_path):
    docs = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 1
    assert docs.first()["round_trip"] and docs.first()["text"] == long_text


def test_long_lines_and_words(spark):
    """No line break, no blank, and white space only."""
    docs = spark.createDataFrame([(1, "ab " * 300_000), (2, "x" * 900_000), (3, " \n" * 400_000), (4, "-----BEGIN PRIVATE KEY-----" + "\n" * 900_000)], "doc_id long, text string")
    for name in ("op2_suffix_dedup", "op3_simhash", "op4_secret_scan", "op6_line_dedup", "op7_sentencepiece", "op9_token_ids", "op10_quality_rules"):
        query = {"op2_suffix_dedup": suffix_dedup.deduped, "op3_simhash": simhash.grouped, "op4_secret_scan": secret_scan.scanned, "op6_line_dedup": line_dedup.deduped, "op7_sentencepiece": pieces.encoded, "op9_token_ids": token_store.stored, "op10_quality_rules": quality.judged}[name]
        assert query(docs).count() == 4 and name in registry.queries()


def test_a_long_url_holds_up_nothing():
    automaton = url_filter.Automaton(url_filter.UrlRules().globs())
    urls = [b"a.com/en/" + b"x" * 1_000_000, b"a.fr/" + b"y" * 1_000_000 + b".exe", b"a.fr/"]
    began = time.time()
    hit = automaton.matches(urls)
    assert time.time() - began < 3 and hit.any(axis=1).tolist() == [True, True, False]
    short = [u[:4000] + u[-90:] for u in urls]
    assert np.array_equal(automaton.matches(short)[:2], np.stack([automaton.walk(u) for u in short[:2]]))


def test_blank_lines_behind_a_marker_take_no_time():
    began = time.time()
    assert secret_scan.confirmed_spans(("-----BEGIN PRIVATE KEY-----" + "\n" * 20_000) * 20) == [] and time.time() - began < 1


def test_header_lines_of_a_key_take_no_time():
    began = time.time()
    text = "-----BEGIN RSA PRIVATE KEY-----\n" + "a:\n" * 160_000 + "-----END RSA PRIVATE KEY-----"
    assert secret_scan.confirmed_spans(text) == [] and time.time() - began < 0.5
