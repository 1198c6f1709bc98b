"""Ranking, frontiers and ordered semantics. Row order is an explicit column; ties go to the earlier row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions.scalars import finite
from fitloom.operators.metrics import valid_metric
from fitloom.operators.ordering import running


def top_n(df: DataFrame, keys: list[str], by: str, n: int, first: list[str], rank: str = "rank") -> DataFrame:
    """The n least of ``by`` in each group, NaN and null last, with ranks 1..n. Spark cuts groups to n rows before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.when(finite(F.col(by)), F.col(by)).asc_nulls_last(), *first)
    return df.withColumn(rank, F.row_number().over(order).cast("long")).filter(F.col(rank) <= n)


def leaders(summary: DataFrame) -> DataFrame:
    """Rows with ``redundant`` 0. A flag that is no whole number of at least 0 is an error."""
    r = F.col("redundant").cast("double")
    bad = r.isNull() | ~finite(r) | (r < 0) | (r != F.floor(r))
    return summary.withColumn("redundant", F.when(bad, F.raise_error(F.lit("redundant must be a whole number of at least 0"))).otherwise(F.col("redundant").cast("long"))).filter("redundant = 0")


def candidates(summary: DataFrame, keys: list[str], n: int = 30, low: int = 7, high: int = 35, first: str = "src_row") -> DataFrame:
    """The n lowest losses of each key within a range of complexity."""
    return top_n(summary.filter(F.col("complexity").between(low, high)), keys, "loss", n, [first])


def lowest_loss(equations: DataFrame, keys: list[str], n: int = 10, low: int = 7, high: int = 40, first: str = "src_row") -> DataFrame:
    """As ``candidates``, but a key without any row in the range falls back to all its rows."""
    inside = F.col("complexity").between(low, high)
    some = F.max(inside).over(W.partitionBy(*keys))
    return top_n(equations.withColumn("some_", some).filter(inside | ~F.col("some_")).drop("some_"), keys, "loss", n, [first])


def top_formulas(summary: DataFrame, n: int, metric: str = "shared_fit_mse_0_7", first: str = "src_row") -> DataFrame:
    """Leaders with a valid metric, the n best of each ID, as TopRank."""
    return top_n(leaders(summary).filter(valid_metric(F.col(metric))), ["ID"], metric, n, [first], "TopRank")


def scored_front(equations: DataFrame, keys: list[str]) -> DataFrame:
    """``score``: minus the change of log loss for a unit of complexity; ``on_front``: loss below all of less complexity."""
    w = W.partitionBy(*keys).orderBy("complexity")
    before, step = F.lag("loss").over(w), F.col("complexity") - F.lag("complexity").over(w)
    best = F.min("loss").over(w.rowsBetween(W.unboundedPreceding, -1))
    return equations.withColumn("score", F.coalesce(-(F.ln("loss") - F.ln(before)) / step, F.lit(0.0))).withColumn("on_front", F.coalesce(F.col("loss") < best, F.lit(True)))


def completed_prefix(marks: DataFrame, keys: list[str], at: str = "dataset", done: str = "done") -> DataFrame:
    """The rows before the first gap or the first that isn't done; ``at`` counts from 0."""
    w = W.partitionBy(*keys).orderBy(at)
    whole = F.col(done) & (F.row_number().over(w) - 1 == F.col(at))
    return marks.withColumn("whole_", whole).withColumn("prefix_", F.min("whole_").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("prefix_").drop("whole_", "prefix_")


def natural_order(name: Column) -> list[Column]:
    """P2 before P10: the letters, then the number, then the text."""
    return [F.regexp_extract(name, r"^(\D*)", 1), F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), name]


def by_id_and_rank(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("ID").cast("string"), "TopRank")


def ranked_rows(rows: DataFrame, rank: int = 1, column: str = "TopRank") -> DataFrame:
    """The rows of one rank; it is an error if there are none."""
    chosen = rows.filter(F.col(column) == rank)
    if not chosen.take(1):
        raise ValueError(f"no row has {column} {rank}")
    return chosen


def heavier_first(work: DataFrame, weight: str, first: str) -> DataFrame:
    """``place`` 1, 2, ...: the heaviest work first, without a weight last, equals by ``first``; numbered by ranges of the order."""
    return running(work.withColumn("minus_", F.coalesce(-F.col(weight), F.lit(float("inf")))), ["minus_", first], "place").drop("minus_")


def chunks(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``chunk`` 0..n-1: contiguous runs of nearly equal length, in order (for a table of IDs)."""
    return df.withColumn("chunk", F.ntile(n).over(W.orderBy(*order)) - 1)


def first_accepted(df: DataFrame, keys: list[str], n: int, draw: str = "draw", accepted: str = "accepted") -> DataFrame:
    return df.filter(F.col(accepted)).withColumn("nth_", F.row_number().over(W.partitionBy(*keys).orderBy(draw))).filter(F.col("nth_") <= n).drop("nth_")
