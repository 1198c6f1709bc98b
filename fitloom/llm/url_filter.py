"""Operator 1: URL filters by a bit-parallel automaton for wildcard patterns.

All glob rules are packed, one bit a pattern position, into the words of one mask (Shift-And). ``?`` is any byte, ``*`` any run
without ``/``, ``**`` any run. A star keeps the position before it alive on the bytes it may swallow, so no empty moves are
needed: for each byte c, state = ((state << 1) & step[c]) | (state & stay[c]). Whole batches of URLs advance together, sorted by
length so that ended ones drop off the end; a very long URL is walked alone, linear in its bytes. Host rules read host and path as they
stand in the URL, block globs read their canonical form (``canonical``).

Null url, or one without ``://``: host and path are empty. Every row gives one row; ids may be null or repeated. Extra columns are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path prefix).
HOST_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Globs over host and path for which a URL without a host rule is blocked.
BLOCK_GLOBS = ("*spam*/**", "*cheap-pills*/**", "*casino*/**", "ads.*/**", "**/wp-login*", "**/*.exe")


#: Texts of more bytes are walked alone.
LONG = 4096


class Automaton:
    """Globs in one multiword mask."""

    def __init__(self, globs: list[str] | tuple[str, ...]):
        starts, ends, letters, stars = [], [], [], []
        at = 0
        for glob in globs:
            starts.append(at)
            state, data, i = at, glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    stars.append((state, True))
                    i += 2
                elif data[i : i + 1] == b"*":
                    stars.append((state, False))
                    i += 1
                else:
                    state += 1
                    letters.append((state, None if data[i : i + 1] == b"?" else data[i]))
                    i += 1
            ends.append(state)
            at = state + 1
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for state in starts:
            self.start[state >> 6] |= np.uint64(1 << (state & 63))
        for state, byte in letters:
            self.step[slice(None) if byte is None else byte, state >> 6] |= np.uint64(1 << (state & 63))
        for state, every in stars:
            self.stay[:, state >> 6] |= np.uint64(1 << (state & 63))
            if not every:
                self.stay[ord("/"), state >> 6] &= ~np.uint64(1 << (state & 63))
        for state in {s for s, every in stars if every} & {s for s, every in stars if not every}:
            self.stay[ord("/"), state >> 6] |= np.uint64(1 << (state & 63))
        self.ends = np.array(ends, np.int64)

    def walk(self, text: bytes) -> np.ndarray:
        """One text alone, its state a single number of all words: a long URL holds up no batch."""
        step, stay = self.numbers
        state = sum(int(w) << 64 * i for i, w in enumerate(self.start))
        for c in text:
            state = (state << 1 & step[c]) | (state & stay[c])
        return np.array([state >> int(e) & 1 for e in self.ends], bool)

    @cached_property
    def numbers(self) -> tuple[list[int], list[int]]:
        return tuple([sum(int(w) << 64 * i for i, w in enumerate(row)) for row in table] for table in (self.step, self.stay))

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row of booleans a text, a column a glob."""
        long = [i for i, t in enumerate(texts) if len(t) > LONG]
        if long:
            out = self.matches([b"" if len(t) > LONG else t for t in texts])
            for i in long:
                out[i] = self.walk(texts[i])
            return out
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        alive = len(texts)
        for k in range(int(lengths[0]) if len(texts) else 0):
            while lengths[alive - 1] <= k:
                alive -= 1
            s, c = state[:alive], data[begin[:alive] + k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            moved &= self.step[c]
            moved |= s & self.stay[c]
            state[:alive] = moved
        out = np.empty((len(texts), len(self.ends)), bool)
        out[order] = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


@dataclass(frozen=True)
class UrlRules:
    """Host rules decide first, the longest that fits; a URL without one is blocked if a block glob matches."""

    host_rules: tuple[tuple[str, str, str], ...] = HOST_RULES
    block_globs: tuple[str, ...] = BLOCK_GLOBS

    @classmethod
    def of(cls, host_rules: DataFrame | None = None, block_globs: DataFrame | None = None) -> UrlRules:
        """From tables (verdict, host, path) and (glob); rules go to every task, so there should be some thousands at most."""
        hosts = HOST_RULES if host_rules is None else tuple((r["verdict"], r["host"], r["path"]) for r in host_rules.select("verdict", "host", "path").distinct().orderBy("host", "path").collect())
        return cls(hosts, BLOCK_GLOBS if block_globs is None else tuple(r["glob"] for r in block_globs.select("glob").distinct().orderBy("glob").collect()))

    def globs(self) -> list[str]:
        """Two globs a host rule, the host itself and its subdomains, then the block globs."""
        return [g for _, host, path in self.host_rules for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(self.block_globs)


def without_dots(path: str) -> str:
    """``path`` without ``.`` and ``..`` segments."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part in (".", ".."):
            if part == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def canonical(host: str, path: str) -> str:
    """Host and path without user part, port and dot segments, with unreserved characters decoded, the host's A-Z in lower case, and ``/``
    for an empty path."""

    def plain(text: str) -> str:
        return re.sub("%(2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])", lambda m: chr(int(m[1], 16)), text)

    if not host and not path:
        return ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), plain(re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2])))
    path = plain(path) or "/"
    return host + (without_dots(path) if "/." in path else path)


def url_filter(urls: DataFrame, key: str, url: str = "url", rules: UrlRules = UrlRules()) -> DataFrame:
    """(key, host, path, rule, verdict, globs) of each row; ``globs`` names the block globs that match.

    Splitting is done by Catalyst, the automaton in Arrow batches; nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = urls.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"))
    # Both globs of a rule, longest rule first.
    ranked = sorted(range(len(rules.host_rules)), key=lambda i: -len(rules.host_rules[i][1] + rules.host_rules[i][2]))
    names = [host + path for _, host, path in rules.host_rules]
    verdicts = [v for v, _, _ in rules.host_rules]
    n = 2 * len(names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules.globs())
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            plain, forms = [h + p for h, p in zip(hosts, paths)], [canonical(h, p) for h, p in zip(hosts, paths)]
            hit = automaton.matches([x.encode("utf-8", "surrogatepass") for x in forms])
            other = [r for r, (a, b) in enumerate(zip(plain, forms)) if a != b]
            if other:  # host rules read these as they stand
                hit[other, :n] = automaton.matches([plain[r].encode("utf-8", "surrogatepass") for r in other])[:, :n]
            rule, verdict = [None] * len(hosts), ["block" if x else "allow" for x in hit[:, n:].any(axis=1)]
            for i in reversed(ranked):
                for r in np.flatnonzero(hit[:, 2 * i] | hit[:, 2 * i + 1]):
                    rule[r], verdict[r] = names[i], verdicts[i]
            globs = [[g for g, x in zip(rules.block_globs, row) if x] for row in hit[:, n:]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(globs, pa.list_(pa.string()))], ["key", "host", "path", "rule", "verdict", "globs"])

    kind = urls.schema[key].dataType.simpleString()
    return parts.mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string, globs array<string>").withColumnRenamed("key", key)


def judged(pages: DataFrame) -> DataFrame:
    """The query's columns."""
    return url_filter(pages.select("page_id", "url"), "page_id").drop("globs")


def as_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        two = glob[i : i + 2] == "**"
        out += "(?s:.*)" if two else "[^/]*" if glob[i] == "*" else "(?s:.)" if glob[i] == "?" else ("\\" if glob[i] in ".+()[]{}^$|\\" else "") + glob[i]
        i += 2 if two else 1
    return f"^{out}$"


def sql(rules: UrlRules = UrlRules()) -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: s.replace("'", "''")
    ranked = sorted(rules.host_rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{q(h)}' or ends_with(host, '.{q(h)}')) and starts_with(path, '{q(p)}')", h + p, v) for v, h, p in ranked]
    rule = " ".join(f"when {f} then '{q(name)}'" for f, name, _ in fits)
    verdict = " ".join(f"when {f} then '{v}'" for f, _, v in fits)
    plain = r"regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') || case when path = '' and host <> '' then '/' else path end"
    globs = " or ".join(f"regexp_matches({plain}, '{q(as_regex(g))}')" for g in rules.block_globs) or "false"
    return f"""
    with r as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
    select page_id, host, path, case {rule} end as rule, case {verdict} when {globs} then 'block' else 'allow' end as verdict from p"""
