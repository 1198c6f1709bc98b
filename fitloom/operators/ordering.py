"""Global order without one task for all rows: ranges of the order, numbered alone, shifted by the totals of the ranges before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.sources import sinks


def running(df: DataFrame, order: list[str], name: str, value: str | None = None) -> DataFrame:
    """``df`` with the running count (or sum of ``value``) in the order of ``order``, which should be unique.

    Rows are dealt to ranges and written with their range's number, so that rows and totals are sure to have the same ranges: the limits
    are sampled, and a second exchange would sample others. What meets in one task for the shift is one row a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sinks.between(df.repartitionByRange(n, *(F.col(f"`{c}`") for c in order)).withColumn("range_", F.spark_partition_id()))
    part = F.lit(1).cast("long") if value is None else F.col(value)
    totals = placed.groupBy("range_").agg(F.sum(part).alias("total_"))
    shift = totals.select("range_", F.coalesce(F.sum("total_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift_"))
    inside = F.sum(part).over(W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("inside_", inside).join(F.broadcast(shift), "range_").withColumn(name, F.col("inside_") + F.col("shift_")).drop("inside_", "shift_", "range_")
