"""Operator 4: secret scan with structural confirmation.

Base patterns find assignments, access keys and long hex strings. Beyond them, base64 and hex candidates are decoded, and a span is
reported only if the bytes parse as what a secret looks like:

* a private key in DER: nested lengths that fill their parents exactly, members in the order of PKCS#1, SEC 1 or PKCS#8, and in PKCS#8
  an inner key of the form that its algorithm has;
* an encrypted PKCS#8 key: an algorithm with parameters and a body;
* an OpenSSH key container: length-prefixed strings down to the key blobs, of which the private one ends the container;
* a signed token: three parts, of which the first two are JSON objects and the header names an algorithm.

A PEM block is confirmed by the bytes in it; one with an encrypted traditional body by its headers, an initial vector of the
algorithm's length and a body of whole blocks. PEM blocks are found by a scan from marker to marker, linear in the text.

Null text: an empty text without spans. Every row gives one row; ids may be null or repeated. Positions are code points. Extra columns
are not looked at. A long text is one row of one task; all scans are linear in it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "pem")
BASE = KINDS[:3]

# Letters in either case, spelled out so that only ASCII letters match.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words and dots that may hold a token: a header that names an algorithm has 14 characters at least.
DOTTED = re.compile(r"[A-Za-z0-9_.-]{18,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}(?![0-9A-Fa-f])")
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
DEK_INFO = re.compile(r"DEK-Info:\s*([A-Z0-9]+(?:-[A-Z0-9]+)+),([0-9A-Fa-f]+)")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: The shortest thing that a pattern other than the assignment finds, in characters without white space.
SHORTEST = 18


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` exactly; None if lengths don't fit or aren't minimal."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 128:
            size = n & 127
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size], "big")
            if n < 128 or n >> 8 * (size - 1) == 0:
                return None
            at += size
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


# Tags of the encoding, and the algorithms of private keys as they are encoded.
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
RSA, EC, DSA, DH = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2a864886f70d010301"))
#: Curve keys are an octet string of so many bytes: X25519, X448, Ed25519, Ed448.
CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}


def only_sequence(data: bytes) -> list[tuple[int, bytes]]:
    """The members of the one sequence that ``data`` is; none if it is something else."""
    outer = der_items(data)
    return (der_items(outer[0][1]) or []) if outer and len(outer) == 1 and outer[0][0] == SEQUENCE else []


def is_pkcs1(items: list[tuple[int, bytes]]) -> bool:
    return [t for t, _ in items[:9]] == [INTEGER] * 9 and len(items[0][1]) == 1 and len(items[1][1]) >= 32 and all(t == SEQUENCE for t, _ in items[9:])


def is_sec1(items: list[tuple[int, bytes]]) -> bool:
    return [t for t, _ in items[:2]] == [INTEGER, OCTETS] and items[0][1] == b"\x01" and len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) and der_items(x) for t, x in items[2:])


def is_pkcs8(items: list[tuple[int, bytes]]) -> bool:
    """The key inside must have the form of the algorithm named; of one that isn't known, that of PKCS#1 or SEC 1."""
    if [t for t, _ in items[:3]] != [INTEGER, SEQUENCE, OCTETS] or len(items[0][1]) != 1 or any(t not in (0xA0, 0x81, 0xA1) for t, _ in items[3:]):
        return False
    algorithm, key = der_items(items[1][1]), items[2][1]
    if not algorithm or algorithm[0][0] != OID:
        return False
    name, inside = algorithm[0][1], der_items(key)
    if not inside or len(inside) != 1:
        return False
    tag, content = inside[0]
    if name in CURVES:
        return tag == OCTETS and len(content) == CURVES[name]
    if name in (DSA, DH):
        return tag == INTEGER and len(content) >= 16
    members = only_sequence(key)
    return is_pkcs1(members) if name == RSA else is_sec1(members) if name == EC else is_pkcs1(members) or is_sec1(members)


def is_private_der(data: bytes) -> bool:
    items = only_sequence(data)
    return is_pkcs1(items) or is_sec1(items) or is_pkcs8(items)


def is_encrypted_der(data: bytes) -> bool:
    """An algorithm with parameters, and a body."""
    items = only_sequence(data)
    if [t for t, _ in items] != [SEQUENCE, OCTETS] or len(items[1][1]) < 16:
        return False
    algorithm = der_items(items[0][1])
    return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == OID and len(algorithm[0][1]) >= 5 and algorithm[1][0] == SEQUENCE and bool(der_items(algorithm[1][1]))


def ssh_strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """``n`` strings with their lengths before them, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def is_openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    found = ssh_strings(data, len(magic), 3)  # cipher, key derivation, its options
    if not found:
        return False
    (cipher, derivation, _), at = found
    n = int.from_bytes(data[at : at + 4], "big")
    if not cipher or not cipher.isascii() or not derivation.isascii() or not 1 <= n <= len(data) // 8:
        return False
    found = ssh_strings(data, at + 4, n + 1)  # public keys, then the private part
    if not found:
        return False
    (*publics, private), at = found
    for blob in publics:
        kind = ssh_strings(blob, 0, 1)
        if not kind or not kind[0][0] or not kind[0][0].isascii() or kind[1] == len(blob):
            return False
    sealed = cipher.endswith((b"gcm@openssh.com", b"poly1305@openssh.com"))
    if len(data) - at not in ((0, 16) if sealed else (0,)) or len(private) < 16 or len(private) % 8:
        return False
    return cipher != b"none" or private[:4] == private[4:8]


def is_signed_token(header: str, claims: str) -> bool:
    for part, name in ((header, "alg"), (claims, None)):
        data = unbase64(part)
        try:
            value = json.loads(data) if data is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or name and not isinstance(value.get(name), str):
            return False
    return True


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if data[:1] == b"\x30" and (is_private_der(data) or is_encrypted_der(data)) else "ssh" if is_openssh(data) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns. Two cheap looks tell most texts apart before a pattern runs."""
    out = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if max(map(len, text.split()), default=0) >= SHORTEST:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens: in each run of words and dots, the first three words in a row that are one, then the words behind them."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 2:
            continue
        words, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(words):
            if len(words[k]) >= 14 and is_signed_token(words[k], words[k + 1]):
                size = sum(len(w) + 1 for w in words[k : k + 3]) - 1
                yield at, at + size
                at += size + 1
                k += 3
            else:
                at += len(words[k]) + 1
                k += 1


def is_pem_body(label: str, body: str) -> bool:
    """Whether what stands between the markers is a key. Line ends may be written out, as in a quoted string."""
    body = body.replace("\\r", "").replace("\\n", "\n").strip()
    dek, at = None, 0
    while (cut := body.find("\n", at)) >= 0 and body.find(":", at, cut) >= 0:  # header lines
        dek = dek or DEK_INFO.match(body[at:cut].strip())
        at = cut + 1
    if not PEM_BODY.fullmatch(body, at):
        return False
    data = unbase64("".join(body[at:].split()))
    if not data:
        return False
    if dek:
        block = 8 if "DES" in dek[1] else 16
        return len(dek[2]) == 2 * block and len(data) % block == 0
    if label.startswith("ENCRYPTED"):
        return is_encrypted_der(data)
    return key_kind(data) is not None


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """From each opening marker to the next five dashes, which must be its closing marker."""
    at = 0
    while m := PEM_BEGIN.search(text, at):
        end, mark = text.find("-----", m.end()), f"-----END {m[1]}PRIVATE KEY-----"
        if end < 0:
            return
        at = end
        if text.startswith(mark, end):
            at = end + len(mark)
            if is_pem_body(m[1], text[m.end() : end]):
                yield m.start(), at


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decodes to a key or a signed token."""
    out = []
    if max(map(len, text.split()), default=0) >= SHORTEST:
        out += [(*span, "jwt") for span in tokens(text)]
        out += [(*m.span(), k) for m in BASE64.finditer(text) if (k := key_kind(unbase64(m[0])))]
        out += [(*m.span(), k) for m in HEX_BYTES.finditer(text) if len(m[0]) % 2 == 0 and (k := key_kind(bytes.fromhex(m[0])))]
    if "-----BEGIN" in text:
        out += [(*span, "pem") for span in pem_spans(text)]
    return out


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in in_order(spans))


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end, found>>) of each row; nothing is shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])
        for batch in batches:
            out = []
            for t in batch.column("t"):
                text = t.as_py() or ""
                out.append([{"kind": k, "start": s, "end": e, "found": text[s:e]} for s, e, k in in_order(base_spans(text) + confirmed_spans(text))])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.list_(span))], ["k", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(of, f"k {kind}, spans array<struct<kind: string, start: long, end: long, found: string>>").withColumnRenamed("k", key)


def scanned(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    spans = F.col("spans")
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan(docs.select("doc_id", "text")).select("doc_id", *(count(k) for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))
