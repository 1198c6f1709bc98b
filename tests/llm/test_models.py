"""Secrets, toxicity, pieces and the token store."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.llm import pieces, secret_scan, token_store, toxicity


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *(der(2, bytes([1]) + bytes(range(1, 65))) for _ in range(8)))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
ED25519 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, b"salt" * 2), der(2, b"\x08\0"))), der(4, bytes(range(48))))
string = lambda b: len(b).to_bytes(4, "big") + b
EC = der(0x30, der(2, b"\1"), der(4, bytes(32)), der(0xA0, der(6, b"\x2b")))
SSH = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + b"\0\0\0\1" + string(string(b"ssh-ed25519") + string(bytes(32))) + string(b"abcdabcd" + string(b"ssh-ed25519") + bytes(17))
b64 = lambda b: base64.b64encode(b).decode()
url64 = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
JWT = f"{url64({'alg': 'HS256', 'typ': 'JWT'})}.{url64({'sub': 1})}.abc-_"


def test_confirmation():
    for data in (RSA, PKCS8, EC):
        assert secret_scan.is_private_der(data) and not secret_scan.is_private_der(data[:-1]) and not secret_scan.is_private_der(data + b"\0")
    assert secret_scan.is_openssh(SSH) and not secret_scan.is_openssh(SSH[:20])
    assert not secret_scan.is_private_der(der(0x30, der(6, b"\x2a"))) and secret_scan.der_items(b"\x30\x81\x05" + bytes(5)) is None
    kinds = lambda t: [k for _, _, k in secret_scan.confirmed_spans(t)]
    assert kinds(f"x {b64(RSA)} y") == ["der"] and kinds(PKCS8.hex()) == ["der"] and kinds(b64(SSH)) == ["ssh"] and kinds(JWT) == ["jwt"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{b64(RSA)}\n-----END RSA PRIVATE KEY-----")[-1] == "pem"
    assert kinds(b64(bytes(range(60)))) == [] and kinds("a" * 64) == [] and kinds(f"{url64({'x': 1})}.{url64({})}.a") == [] and kinds(f"{url64({'alg': 'x'})}.bad.a") == []


def base_brute(t):
    t = t or ""
    keys = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secret_scan(docs):
    rng = random.Random(0)
    bits = ['token = "', "Token:", "pass", "password='", "SECRET  :  ", "api_key=", "apikey:", "K\u212aey", "\u017fecret=abcdefgh", "AKIA", "AKIA" + "A1" * 10, "deadbeef" * 4, "é", " ", "\n", "abc123", "=", "x.y-z/+", "\U0001f600", "a" * 30, JWT, b64(EC)]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(None, None), (1000, ""), (1, "token: abcdef"), (1001, "z" * 200_000 + " token=abcdef")]
    out = secret_scan.scanned(docs(rows)).collect()
    assert len(out) == len(rows)
    left = [(d, base_brute(t)) for d, t in rows]
    for r in out:
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in secret_scan.BASE)
        left.remove((r["doc_id"], base))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [base.count(k + ":") for k in secret_scan.BASE] == [r["n_assign"], r["n_access"], r["n_hex"]]
    assert any("jwt" in r["spans"] for r in out) and any("der" in r["spans"] for r in out)
    found = secret_scan.secret_scan(docs([(1, "é token=abcdef")])).first()["spans"][0]
    assert (found["start"], found["found"]) == (2, "token=abcdef") and secret_scan.scanned(docs([])).count() == 0


def toxic_rows(n=1500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 7 == 0
        w = [word() for _ in range(rng.randint(10, 200))]
        if bad:
            for x in rng.sample(["zany", "zorkish", "zupper", "zilch"], 3):
                w[rng.randrange(len(w))] = x
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs):
    rows, labels = toxic_rows()
    rows += [(None, "x"), (5000, None), (5001, "")]
    lab = spark.createDataFrame([*labels, (None, 1), (0, 0), (2, None)], "doc_id long, toxic int")
    out = toxicity.scored(docs(rows), lab).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r for r in out}
    assert all(by[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in rows if d is not None) and not by[None]["held_out"]
    held = [d for d in range(1500) if by[d]["held_out"]]
    good = np.mean([by[d]["predicted"] == (d % 7 == 0) for d in held])
    assert good > 0.97
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(rows).repartition(3), lab.repartition(2)).collect()}
    assert all(abs(again[d] - by[d]["score"]) < 1e-6 for d in again)
    # Labels of the held-out fold change nothing.
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(docs(rows), flipped).collect()} == {d: r["score"] for d, r in by.items()}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scored(docs([(1, "a")]), none).collect()] == [0.0] and toxicity.scored(docs([]), none).count() == 0


def test_risk_is_kept_from_below_zero():
    z, positive = np.array([3.0, 3.0, -3.0, -3.0]), np.array([True, True, False, False])
    assert (toxicity.nnpu_gradient(z, positive, 0.9)[~positive] < 0).all()  # the unlabelled part is too well fitted: back
    assert (toxicity.nnpu_gradient(z, positive, 0.001)[~positive] > 0).all()


TEXTS = ["", " ", "Hello  world", "a\n\tb", "é日本 \U0001f600", "   ", "x" + " " * 17 + "y", "The quick brown fox. " * 30, "word" * 5000, "\x00\x01", "naïve façade", "ab\u0301c"]


def test_pieces_are_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeé ,.\n日T") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    machine = pieces.Transducer(pieces.default_model())
    for t in texts:
        ids = machine.encode(t)
        assert ids == library.encode(t) and machine.decode(ids) == t
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    coded = pieces.encode(docs(rows))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded).collect()}
    assert back == {d: t or "" for d, t in rows}
    out = {r["doc_id"]: r for r in pieces.encoded(docs(rows)).collect()}
    assert all(out[d]["ids_crc32"] == zlib.crc32(np.array(library.encode(t or ""), "<u4").tobytes()) and out[d]["round_trip"] for d, t in rows)
    assert pieces.encoded(docs([])).count() == 0


def test_shortest_path_of_a_unigram_model():
    machine = pieces.Transducer(pieces.default_model())
    machine.model_type = pieces.UNIGRAM
    scores = {"▁ab": -5.0, "▁a": -1.0, "b": -1.5, "▁": -1.0, "a": -4.0, "ab": -1.2}
    machine.texts, machine.scores = list(scores), list(scores.values())
    machine.ids = {t: i for i, t in enumerate(machine.texts)}
    machine.kinds = [pieces.NORMAL] * len(scores)
    end = lambda i, way: (i, way)
    machine.trie = {"▁": end(3, {"a": end(1, {"b": end(0, None)})}), "a": end(4, {"b": end(5, None)}), "b": end(2, None)}

    def best(text):
        if not text:
            return 0.0
        return max((scores[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores), default=-1e18)

    for text in ("▁ab", "▁aab", "▁abab", "▁b"):
        assert np.isclose(sum(scores[machine.texts[i]] for i in machine.shortest(text)), best(text))


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 7, 64, 1000):
        ids = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
        h = token_store.key_hash(ids, np.zeros(n, bool), np.zeros(n, np.int64), 0)
        assert sorted(token_store.MinimalPerfectHash.build(h).slots(h).tolist()) == list(range(n))
    assert token_store.MinimalPerfectHash.build(np.array([5, 5], np.uint64)) is None


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.default_tokenizer())
    rng = random.Random(6)
    texts = TEXTS + ["Don't STOP <|endoftext|>'s İI ΣΑΣ", "a\xa0b\x1cc\u2003d", None] + ["".join(rng.choice("abcDE'é1 .,\n!<|>") for _ in range(rng.randint(0, 200))) for _ in range(120)]
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)] + [(2, "b"), (2, "a"), (None, "null id"), (None, None)]
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, token_store.END_ID]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected, start = [], 0
    for d, t in order:
        ids = np.array(encode(t), "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_store.stored(docs(rows)).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    folder, manifest = token_store.write_store(docs(rows), shards=3)
    wanted = {d: t for d, t in rows if d not in (2, None)}
    seen = {}
    for m in manifest.collect():
        shard = token_store.Shard(folder, f"{m['shard']:05d}")
        ids = np.array(list(wanted), np.int64)
        found, offsets, lengths = shard.find(ids)
        for d, o, n in zip(ids[found].tolist(), offsets[found], lengths[found]):
            seen[d] = shard.read(int(o), int(n)).tolist()
        assert not shard.find(np.arange(10**6, 10**6 + 1000))[0].any()
    assert seen == {d: encode(t) for d, t in wanted.items()}
    assert token_store.stored(docs([])).count() == 0
