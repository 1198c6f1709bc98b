"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fitloom.llm import centroids, chat, decontaminate, line_dedup, pieces, quality, secret_scan, simhash, source_audit, suffix_dedup, token_store, toxicity, url_filter
from fitloom.llm.common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": _over("pages", url_filter.judged),
        "op2_suffix_dedup": _over("documents", suffix_dedup.deduped),
        "op3_simhash": _over("documents", simhash.grouped),
        "op4_secret_scan": _over("documents", secret_scan.scanned),
        "op5_toxicity": lambda spark, sf_dir: toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op6_line_dedup": _over("documents", line_dedup.deduped),
        "op7_sentencepiece": _over("documents", pieces.encoded),
        "op8_decontaminate": lambda spark, sf_dir: decontaminate.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op9_token_ids": _over("documents", token_store.stored),
        "op10_quality_rules": _over("documents", quality.judged),
        "op11_centroids": _over("embeddings", centroids.assigned),
        "op12_chat": _over("conversations", chat.conversed),
        "op13_source_audit": _over("documents", source_audit.audited),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.sql(), "op6_line_dedup": line_dedup.SQL, "op8_decontaminate": decontaminate.SQL, "op10_quality_rules": quality.sql(), "op11_centroids": centroids.sql(), "op12_chat": chat.SQL, "op13_source_audit": source_audit.SQL}
