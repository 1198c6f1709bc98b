"""Joins, set operations and checks, with the reference semantics of keys: missing, unexpected and repeated ones are made visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions.scalars import masked
from fitloom.operators.ordering import running
from fitloom.sources import sinks


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, in which a key that occurs twice is an error when it is read."""
    from pyspark.sql import Window as W

    n = F.count("*").over(W.partitionBy(*keys))
    message = F.concat(F.lit("repeated key "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return df.withColumn("n_", n).filter(F.when(F.col("n_") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("n_")


def attach_master(ranked: DataFrame, master: DataFrame, key: str, suffix: str = "_summary") -> DataFrame:
    """All ranked rows with their master row, one to many: master keys must be unique; shared names of the ranked side get the suffix."""
    shared = [c for c in ranked.columns if c in master.columns and c != key]
    left = ranked.withColumnsRenamed({c: c + suffix for c in shared})
    return left.join(require_unique(master, [key]), key, "left")


def unmatched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other, key, "left_anti").select(key).distinct()


def task_spine(spark: SparkSession, n: int = 59, prefix: str = "P") -> DataFrame:
    """P01..P59."""
    return spark.range(1, n + 1).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 2, "0")).alias("ID"))


def on_spine(df: DataFrame, spine: DataFrame, key: str, fill: dict[str, object] | None = None) -> DataFrame:
    """A row for each key of the spine, filled where there is none; keys outside the spine are an error."""
    strange = df.join(spine, key, "left_anti").select(F.raise_error(F.concat(F.lit("unexpected key "), F.col(key).cast("string"))).cast("boolean").alias("x_"))
    present = df.withColumn("there_", F.lit(True))
    out = spine.join(present, key, "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.when(F.col("there_").isNull(), F.lit(v)).otherwise(F.col(c)))
    check = strange.agg(F.count("x_").alias("x_"))  # one row, or the error
    return out.drop("there_").join(F.broadcast(check)).filter("x_ = 0").drop("x_")


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [t.select(key) for t in tables])


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """By name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def band_counts(df: DataFrame, key: str, x: str, y: str, dx: float = 5.0, dy: float = 1.0) -> DataFrame:
    """(key, near): how many other rows lie within dx of x and dy of y (both inclusive; limits are x - dx, x + dx and so on).

    No pairs are made. Distinct x are numbered, and a run of numbers is a few nodes of a binary tree over them; a point stands in the
    node of each level, a band asks at the two ends of its y in each node that it is made of. One running count over (node, y) answers
    all of them, so the work is that of n log n rows, however dense the points are.
    """
    points = sinks.between(df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")).filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    columns = points.select("x").distinct()
    limit = lambda at, kind: columns.select((F.col("x") + at).alias("v"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("c"), "x")
    # Of each x: how many distinct ones lie before its band, and up to the band's end.
    numbered = running(limit(0.0, 1).withColumn("c", F.lit(1).cast("long")).unionByName(limit(-dx, 0)).unionByName(limit(dx, 2)), ["v", "kind"], "n", "c")
    when = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    places = sinks.between(numbered.groupBy("x").agg((when(1) - 1).alias("place"), when(0).alias("first"), when(2).alias("end")))
    levels = max(1, places.count().bit_length())
    node = lambda k, n: F.shiftleft(k.cast("long"), 48).bitwiseOR(n)
    level = F.sequence(F.lit(0), F.lit(levels))
    up = lambda c, k: F.call_function("shiftright", c, k)

    def parts(k: Column) -> Column:
        """The nodes of level k that the run [first, end) is made of: at most one at each side."""
        lo, hi = -up(-F.col("first"), k), up(F.col("end"), k)
        some = lo < hi
        return F.array(F.when(some & (lo % 2 == 1), node(k, lo)), F.when(some & (hi % 2 == 1), node(k, hi - 1)))

    placed = points.join(places, "x")
    held = placed.select(F.explode(F.transform(level, lambda k: node(k, up(F.col("place"), k)))).alias("node"), F.col("y").alias("v"), F.lit(1).alias("kind"), "c", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    asked = placed.select("x", "y", F.explode(F.filter(F.flatten(F.transform(level, parts)), lambda n: n.isNotNull())).alias("node"))
    ends = asked.select("node", F.explode(F.array(F.struct((F.col("y") - dy).alias("v"), F.lit(0).alias("kind")), F.struct((F.col("y") + dy).alias("v"), F.lit(2).alias("kind")))).alias("e"), "x", "y")
    events = held.unionByName(ends.select("node", "e.v", "e.kind", F.lit(0).cast("long").alias("c"), "x", "y"))
    counted = running(events, ["node", "v", "kind"], "n", "c").filter("kind <> 1")
    near = counted.groupBy("x", "y").agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(-F.col("n"))).alias("n"))
    rows = df.select(key, F.col(x).alias("x"), F.col(y).alias("y"))
    return rows.join(near, ["x", "y"]).select(key, (F.col("n") - 1).alias("near"))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`") for c in columns], name, value)


def widen(df: DataFrame, keys: list[str], level: str, levels: list[str], values: list[str]) -> DataFrame:
    """One column a level and value, named level_VALUE; the levels are given, so no job looks for them."""
    exprs = [F.max(F.when(F.col(level) == lv, F.col(v))).alias(f"{lv}_{v.upper()}") for lv in levels for v in values]
    return df.groupBy(*keys).agg(*exprs)


def without_sentinels(df: DataFrame, columns: list[str], limit: float = -1e50) -> DataFrame:
    return df.withColumns({c: masked(F.col(c), limit) for c in columns})


def all_negative(columns: list[str]):
    """Whether all values are there and below 0; a failure's sentinel is no value."""
    return reduce(lambda a, b: a & b, [F.coalesce(masked(F.col(c)) < 0, F.lit(False)) for c in columns])


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done, keys, "left_anti")


def incomplete(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows of which a metric isn't there or isn't finite."""
    from fitloom.functions.scalars import finite

    return summary.filter(~reduce(lambda a, b: a & b, [finite(F.col(m)) for m in metrics]))


def in_range(x, lo, hi, tolerance: float = 1e-10):
    """Within [lo, hi], widened by a tolerance relative to the larger limit."""
    tol = tolerance * F.greatest(F.lit(1.0), F.abs(lo), F.abs(hi))
    return x.between(lo - tol, hi + tol)
