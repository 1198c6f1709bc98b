"""Operator 10 [native]: quality rules that clean lines first.

Every line is judged alone (symbols, navigation, shouting, boilerplate, closing punctuation); lines that fail go, and a
document goes when too little of its text is left. A few whole-document base rules come first.

Null text: a text without words; ``n_words`` is 0 and ``base_failed`` true. Every input row gives one output row, so repeated
rows and null ids come through as they are. Extra columns are carried along by ``quality_rules``, whatever their names; a column
``quality_rules_`` of the table makes the new one's name longer. A text of any length is measured in one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import WORD, fresh, let, quoted, words

# Phrases of page furniture and notices.
BOILERPLATE = (
    "all rights reserved", "copyright", "licensed under", "license agreement", "privacy policy", "terms of use", "terms of service",
    "cookie policy", "accept cookies", "subscribe to our", "sign up for", "click here", "read more", "enable javascript", "lorem ipsum",
)
SYMBOLS = r"[#*$%&|<>]"
NAVIGATION = r"[|»›•]"
#: The end of a sentence, anywhere in the line.
CLOSING = r"""[.!?…:;。！？]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; ``least_kept`` is the part of a document's worded-line characters that must remain."""

    symbol_share: float = 0.1
    fields: int = 3
    words_a_field: int = 4
    shouted_share: float = 0.6
    shouted_words: int = 5
    unclosed_words: int = 3
    boilerplate: tuple[str, ...] = BOILERPLATE
    least_kept: float = 0.5


RULES = LineRules()


def line_fails(line: Column, rules: LineRules = RULES) -> Column:
    """Whether a line goes. Each count is one pass over the line, so the rarer condition of a rule stands first."""
    n = F.regexp_count(line, F.lit(WORD + "+"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    marks = F.regexp_count(line, F.lit(NAVIGATION))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    furniture = let(F.lower(line), lambda low: reduce(or_, (low.contains(x) for x in rules.boilerplate), F.lit(False)))
    return (
        ((symbols > 0) & (symbols > F.regexp_count(line, F.lit(WORD)) * F.lit(rules.symbol_share)))
        | ((marks >= rules.fields) & (n <= (marks + 1) * rules.words_a_field))
        | ((F.regexp_count(line, F.lit(r"\p{Lu}")) > letters * F.lit(rules.shouted_share)) & (n >= rules.shouted_words))
        | (~line.rlike(CLOSING) & (n >= rules.unclosed_words))
        | furniture
    )


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``w``.

    Without two hashes alike there are none. Else windows are sorted as 34 bits of hash and 30 bits of position in one long; only windows whose hash has a neighbour like it are
    built as text and compared exactly.
    """
    low = (1 << 30) - 1
    none = F.array().cast("array<bigint>")

    def alike(s: Column, part) -> Column:
        return F.filter(s, lambda x, j: F.coalesce(part(x) == part(F.get(s, j + 1)), F.lit(False)) | F.coalesce((j > 0) & (part(x) == part(F.get(s, j - 1))), F.lit(False)))

    def suspected(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.shiftleft(x, 30).bitwiseOR(i.cast("bigint")))
        found = let(F.sort_array(placed), lambda s: alike(s, lambda x: F.shiftright(x, 30)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(found)

    hashed = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(none)
    suspects = let(hashed, suspected)

    def window(x: Column) -> Column:
        return let(x.bitwiseAND(F.lit(low)).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("g"), p.alias("p")))

    found = let(F.sort_array(F.transform(suspects, window)), lambda s: F.transform(alike(s, lambda x: x["g"]), lambda x: x["p"]))
    covered = let(F.sort_array(found), lambda ps: F.aggregate(F.transform(ps, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(ps, j + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return covered


def measure(text: Column, rules: LineRules = RULES) -> Column:
    """A struct of the base counts and of what the line rules leave."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.length(F.array_join(lines, "")).cast("bigint").alias("line_chars"),
            F.filter(lines, lambda x: ~line_fails(x, rules)).alias("clean_lines"),
        )

    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint")
    return F.struct(let(words(text), of_words).alias("w"), let(worded_lines(text), of_lines).alias("l"), symbols.alias("n_symbols"))


def quality_rules(docs: DataFrame, text: str = "text", rules: LineRules = RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``clean_text`` and ``kept`` as the fields of one new struct column ``quality_rules_``."""
    name = fresh(docs, "quality_rules_")
    raw = fresh(docs, "quality_raw_")
    # The array of one row keeps a filter on the verdict from being pushed below, where all would be measured again.
    out = docs.select("*", F.explode(F.array(measure(F.col(quoted(text)), rules))).alias(raw))
    m = F.col(raw)
    n, again = m["w"]["n_words"], m["w"]["n_repeat_words"]
    failed = (n < 50) | (100 * again > 50 * n)
    left = F.length(F.array_join(m["l"]["clean_lines"], ""))
    return out.withColumn(
        name,
        F.struct(
            n.alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"), again.alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & (left >= m["l"]["line_chars"] * F.lit(rules.least_kept))).alias("kept"), F.array_join(m["l"]["clean_lines"], "\n").alias("clean_text"),
        ),
    ).drop(raw)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = quality_rules(docs.select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"quality_rules_.{c}").alias(c) for c in COLUMNS))


def sql(rules: LineRules = RULES) -> str:
    """The same in DuckDB's SQL."""
    word = r"[^\x20\x09-\x0D]"
    phrases = "|".join(rules.boilerplate)

    def count(line: str, pattern: str) -> str:
        return f"len(regexp_extract_all({line}, '{pattern}'))"

    closing = CLOSING.replace("'", "''")
    fails = f"""(
        {count('x', SYMBOLS)} > {count('x', word)} * {rules.symbol_share}::DOUBLE
        or ({count('x', NAVIGATION)} >= {rules.fields} and {count('x', word + '+')} <= ({count('x', NAVIGATION)} + 1) * {rules.words_a_field})
        or ({count('x', word + '+')} >= {rules.shouted_words} and {count('x', chr(92) + 'p{Lu}')} > {count('x', chr(92) + 'p{L}')} * {rules.shouted_share}::DOUBLE)
        or ({count('x', word + '+')} >= {rules.unclosed_words} and not regexp_matches(x, '{closing}'))
        or regexp_matches(x, '(?i){phrases}'))"""
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    s as (select r, doc_id, t, regexp_extract_all(t, '{word}+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as l from d),
    g as (select r, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from s where len(w) >= 3),
    k as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from g),
    c as (select r, count(distinct i + o) as again from k, (values (0), (1), (2)) v(o) where n > 1 group by r),
    m as (select s.doc_id, len(w)::BIGINT as n_words, length(array_to_string(w, ''))::BIGINT as word_chars, (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT as n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT as n_dup_lines, coalesce(again, 0)::BIGINT as n_repeat_words,
        length(array_to_string(l, '')) as all_chars, length(array_to_string(list_filter(l, lambda x: not {fails}), '')) as kept_chars
        from s left join c on s.r = c.r)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
        (n_words >= 50 and 100 * n_repeat_words <= 50 * n_words and kept_chars >= all_chars * {rules.least_kept}::DOUBLE) as kept
    from m"""
