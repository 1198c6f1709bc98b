"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir). ``docs`` has doc_id and text; further columns, whatever their names, are carried along, by all
stages but the last, and ``n_chars``, where it is there, fits the text. Null texts count as empty ones: quality_rules rejects them, and
so every text under 50 words. Rows alike in id and text are one document: near_dedup keeps one of them, the other stages give them one
verdict. Of equals the least id counts, a null id last. Texts may be of any length; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm import decontaminate, line_dedup, pieces, quality, simhash
from fitloom.llm.common import WORD, clean, made, quoted, reader, scratch, table


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with a new text, and ``n_chars`` (where it is a column) that fits it."""
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*map(quoted, columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    judged = quality.quality_rules(docs)
    verdict = quoted(judged.columns[-1])
    return _with_text(judged.filter(F.col(f"{verdict}.kept")), F.col(f"{verdict}.clean_text"), docs.columns)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of windows that stand earlier; a document that had words and has none left goes."""
    out = line_dedup.line_dedup(docs)
    text, _, n_removed = (F.col(quoted(c)) for c in out.columns[-3:])
    return _with_text(out.filter((n_removed == 0) | text.rlike(WORD)), text, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of every document, the text that they decode to, and n_tokens, ids_crc32 and round_trip."""
    return pieces.encoded(docs, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Finite-state encoding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What the stages leave in the shared folder is deleted as soon as the next stage is written."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for i, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = reader(spark).parquet(path)
        clean(spark, mark, {path})
    return docs
