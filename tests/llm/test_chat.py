"""Operator 12 against paths and texts made in Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from fitloom.llm import chat

NODES = "tree long, node string, parent string, role string, text string, score double"


def brute(rows, branches):
    """{(tree, branch): [(role, text)]} by walking up from each leaf."""
    out, trees = {}, defaultdict(dict)
    key = lambda x: (x is not None, x or "" if not isinstance(x, float) else x)
    for tree, node, parent, role, text, score in sorted(rows, key=lambda r: (key(r[2]), r[3] or "", r[4] or "", key(r[5]))):
        trees[tree].setdefault(node, (parent, role or "", text or "", score or 0.0))
    for tree, nodes in trees.items():
        leaves = []
        for leaf in set(nodes) - {n[0] for n in nodes.values()}:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][0]
            if len(path) <= len(nodes):
                leaves.append((-sum(nodes[n][3] for n in path) / len(path), -len(path), leaf, path[::-1]))
        for i, (_, _, _, path) in enumerate(sorted(leaves)[:branches], 1):
            out[tree, i] = [nodes[n][1:3] for n in path]
    return out


def read(output):
    got, loss = defaultdict(list), defaultdict(str)
    for r in sorted(output.collect(), key=lambda r: (r["tree"] is not None, r["tree"], r["branch"], r["part"])):
        got[r["tree"], r["branch"]] += list(chat.parsed(r["text"]))
        loss[r["tree"], r["branch"]] += "".join(chat.unescape(r["text"][s["begin"] : s["end"]]) for s in r["loss"])
    return dict(got), dict(loss)


@pytest.mark.parametrize("branches", [1, 3, 100])
def test_trees(spark, branches):
    rng = random.Random(branches)
    rows = []
    for tree in range(12):
        n = rng.randint(1, 30)
        for i in range(n):
            parent = None if i == 0 else str(max(0, i - rng.choice([1, 1, 1, 2, 9])))
            rows.append((tree, str(i), parent, rng.choice(["user", "assistant"]), f"text {i} </s>", float(rng.randint(0, 3))))
    rows += [(50, str(i), str(i - 1), "assistant", f"deep {i}", 1.0) for i in range(100)]
    want = brute(rows, branches)
    got, loss = read(chat.format_trees(spark.createDataFrame(rows, NODES), branches, score="score"))
    assert got == want
    assert {k: v for k, v in loss.items()} == {k: "".join(t for r, t in v if r == "assistant") for k, v in want.items()}


def test_odd_trees(spark):
    """Orphans are roots; circles have none; repeated nodes count once; null trees, texts, roles and scores."""
    rows = [
        (1, "a", "gone", "user", "orphan", None), (1, "b", "a", "assistant", None, 2.0), (1, "b", "a", "assistant", None, 2.0), (1, "b", "a", "zzz", "later", 9.0),
        (2, "x", "y", "user", "circle", 1.0), (2, "y", "x", "user", "circle", 1.0), (2, "z", "x", "user", "below it", 1.0), (2, "self", "self", "user", "own child", 1.0),
        (None, "a", None, None, "of the null tree", 1.0), (None, "b", "a", "assistant", "also", 1.0), (3, "only", None, "user", "", 0.0),
    ]
    got, _ = read(chat.format_trees(spark.createDataFrame(rows, NODES), 5, score="score"))
    assert got == {(1, 1): [("user", "orphan"), ("assistant", "")], (None, 1): [("", "of the null tree"), ("assistant", "also")], (3, 1): [("user", "")]}


def test_ranks(spark):
    rows = [(1, "r", None, "user", "q", 0.0), (1, "a", "r", "assistant", "bad", 1.0), (1, "b", "r", "assistant", "good", 5.0), (1, "c", "r", "assistant", "as good", 5.0), (1, "d", "c", "user", "go on", 2.5)]
    got, _ = read(chat.format_trees(spark.createDataFrame(rows, NODES), 2, score="score"))
    # means: a 0.5, b 2.5, d 2.5 and longer
    assert got == {(1, 1): [("user", "q"), ("assistant", "as good"), ("user", "go on")], (1, 2): [("user", "q"), ("assistant", "good")]}


def test_escapes_are_reversible():
    rng = random.Random(1)
    bits = ["<", "[", "\\", "\\\\", "s>", "/s>", "/", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|", "|turn|>", "|end|>\n", "<|text|>", "|>", "x", "</s>", "[INST]", "\n", "", "é"]
    for _ in range(20_000):
        role, text = "".join(rng.choices(bits, k=rng.randint(0, 3))), "".join(rng.choices(bits, k=rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", chat.TURN, chat.TEXT, chat.END))
        turn, begin = chat.formatted(role, text)
        assert list(chat.parsed(turn * 2)) == [(role, text)] * 2 and turn[begin : -len(chat.END)] == safe


def test_what_is_no_conversation():
    for bad in ("x", f"{chat.TURN}user", f"{chat.TURN}user{chat.TEXT}x", f"{chat.TURN}u{chat.TEXT}x{chat.END}y"):
        with pytest.raises(ValueError, match="template"):
            list(chat.parsed(bad))


def test_escape_is_linear():
    import time

    began = time.time()
    for text in ("<|" + "a" * 3_000_000, "<" + "\\" * 3_000_000, "[" * 3_000_000, "<|" * 1_500_000):
        assert chat.unescape(chat.escape(text)) == text
    assert time.time() - began < 5


def test_long_conversations_have_parts(spark):
    """A conversation of eight million characters, in parts of about one; the digests are those of the whole."""
    turns = [(7, i, "assistant" if i % 2 else "user", f"{i} " + "é<s>" * 100_000) for i in range(20)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    output = chat.format_trees(chat.chains(df), known_unique=True)
    sizes = [len(r["text"]) for r in output.collect()]
    assert 5 <= len(sizes) <= 20 and max(sizes) <= chat.PART + 600_000
    row = next(r for r in chat.conversed(df).collect() if r["conv_id"] == 7)
    assert row["n_turns"] == 20 and row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    said = "".join(t for _, _, r, t in turns if r == "assistant")
    assert row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "a"), (1, None, "user", "first"), (None, 0, "user", "of none"), (None, 1, "assistant", "x"), (2, 0, None, "no role"), (-1, 7, "user", "at the end")]
    df = spark.createDataFrame([(*r, "n", "t") for r in rows], "conv_id long, turn long, role string, text string, node string, tree string")
    got = {r["conv_id"]: r for r in chat.conversed(df).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    want = {1: [("user", "first"), ("assistant", "a"), ("user", ""), ("user", "")], None: [("user", "of none"), ("assistant", "x")], 2: [("", "no role")], -1: [("user", chat.HOSTILE), ("assistant", chat.HOSTILE), ("user", "at the end")]}
    assert {k: (r["n_turns"], r["turns_sha256"]) for k, r in got.items()} == {k: (len(v), digest(v)) for k, v in want.items()}


def test_of_nothing(spark):
    empty = chat.conversed(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in empty] == [(-1, 2, len(chat.HOSTILE))]
    assert chat.format_trees(spark.createDataFrame([], NODES)).collect() == []
