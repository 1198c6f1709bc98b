import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm.url_filter import Automaton, UrlRules, as_regex, judged, url_filter

GLOBS = ["com/en/**", "*.com/en/**", "**/*.exe", "a?c", "*", "**", "", "*spam*/**", "/a*b/**/c", "?" * 70 + "*x"]


@given(st.lists(st.text("ab/.cmenspx", max_size=90), max_size=20))
@settings(max_examples=60, deadline=None)
def test_automaton_is_the_regular_expression(texts):
    hit = Automaton(GLOBS).matches([t.encode() for t in texts])
    assert hit.tolist() == [[bool(re.fullmatch(as_regex(g)[1:-1], t)) for g in GLOBS] for t in texts]


def test_bytes_beyond_ascii():
    assert Automaton(["é*", "??"]).matches(["é".encode(), b"ab"]).tolist() == [[True, True], [False, True]]


CASES = [
    ("http://X.Example.COM/en/71?a", "x.example.com", "/en/71", "example.com/en/7", "allow"), ("http://a.com/en/8", "a.com", "/en/8", "com/en/", "block"), ("http://com/en/", "com", "/en/", "com/en/", "block"), ("https://xcom/en/1", "xcom", "/en/1", None, "allow"),
    ("http://h.net/de/", "h.net", "/de/", "net/de/", "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("http://s.org?x=/es/", "s.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://a://b/c", "a:", "//b/c", None, "allow"), ("http://spam-x.fr/1#y", "spam-x.fr", "/1", None, "block"), ("http://a.fr/b/com/en/", "a.fr", "/b/com/en/", None, "allow"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "host") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in judged(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, verdict), CASES[i]


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)], [(1, "http://" + "a" * 100_000 + ".com/en/x")] * 2])
def test_edges(spark, rows):
    assert judged(spark.createDataFrame(rows, "page_id long, url string")).count() == len(rows)


def test_globs_are_named(spark):
    df = spark.createDataFrame([(1, "http://a.fr/x.exe")], "k long, u string")
    row = url_filter(df, "k", "u", UrlRules((), ("**/*.exe", "*a*/**"))).first()
    assert row["globs"] == ["**/*.exe", "*a*/**"] and row["rule"] is None and np.all(row["verdict"] == "block")
