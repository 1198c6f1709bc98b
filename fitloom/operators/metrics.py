"""Fit metrics and summary statistics as plain aggregates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.scalars import ERROR_MSE, ERROR_R2, FAILED, finite, masked
from fitloom.functions.special import correlation_p
from fitloom.operators.ordering import running
from fitloom.sources import sinks

#: SSE up to which a constant target counts as met.
EXACT = 1e-24


def sse(y: Column, fitted: Column) -> Column:
    return F.sum((y - fitted) * (y - fitted))


def sst(y: Column) -> Column:
    """Exactly 0 for a constant, whose variance merged from many parts is not always."""
    return F.when(F.min(y) == F.max(y), 0.0).otherwise(F.var_pop(y) * F.count(y))


def r2_of(sse_: Column, sst_: Column, constant_target: str = "shared") -> Column:
    """1 - SSE / SST. For a constant target: 1 if it is met, else the sentinel (``shared``) or null (``strict``, where only 0 is met)."""
    flat = F.when(sse_ <= (EXACT if constant_target == "shared" else 0.0), 1.0).otherwise(F.lit(ERROR_R2) if constant_target == "shared" else F.lit(None).cast("double"))
    return F.when(sst_ == 0, flat).otherwise(1.0 - sse_ / F.when(sst_ != 0, sst_))


def nmse_of(sse_: Column, sst_: Column) -> Column:
    """SSE / SST; for a constant target 0 if it is met, else null."""
    return F.when(sst_ == 0, F.when(sse_ == 0, 0.0)).otherwise(sse_ / F.when(sst_ != 0, sst_))


def fit_metrics(rows: DataFrame, keys: list[str], y: str = "y", fitted: str = "fitted", constant_target: str = "shared") -> DataFrame:
    """(keys, n, mse, nmse, r2, ok): one pass, partial sums before the shuffle. A group with a prediction that isn't finite has failed."""
    bad = ~finite(F.col(fitted))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), sse(F.col(y), F.col(fitted)).alias("sse_"), sst(F.col(y)).alias("sst_"), F.max(bad).alias("bad_"))
    s, t = F.col("sse_"), F.col("sst_")
    r2, nmse = r2_of(s, t, constant_target), nmse_of(s, t)
    ok = ~F.col("bad_") & (r2.isNotNull() if constant_target == "strict" else F.lit(True))
    return sums.select(*keys, "n", F.when(ok, s / F.col("n")).alias("mse"), F.when(ok, nmse).alias("nmse"), F.when(ok, r2).alias("r2"), ok.alias("ok"))


def mean(x: Column) -> Column:
    return F.avg(x)


def harmonic(x: Column, failed: float = ERROR_MSE) -> Column:
    """Only if all values are above 0, else the sentinel."""
    return F.when(F.min(x) > 0, F.count(x) / F.sum(1.0 / F.when(x != 0, x))).otherwise(failed)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def all_or_nothing(fits: DataFrame, keys: list[str], group: str = "grp") -> DataFrame:
    """Six means over the groups of a formula, all of them the sentinel if one group has failed, and the groups by outcome.

    ``fits``: keys, group, ok, mse, r2, retry_used. A formula has few groups (eight or sixteen), so lists of them are small.
    """
    whole = F.bool_and("ok")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(group))))
    mse, r2 = F.when(F.col("ok"), F.col("mse")), F.when(F.col("ok"), F.col("r2"))
    out = []
    for name, x, failed in (("mse", mse, ERROR_MSE), ("r2", r2, ERROR_R2)):
        out += [F.when(whole, f).otherwise(failed).alias(f"{name}{part}") for part, f in (("", mean(x)), ("_hmean", harmonic(x, failed)), ("_rms", rms(x)))]
    return fits.groupBy(*keys).agg(*out, listed(F.col("ok")).alias("success_groups"), listed(~F.col("ok")).alias("failed_groups"), listed(F.col("retry_used")).alias("retry_groups"))


def undiluted(x: Column, ok: Column, failed: float) -> Column:
    """A mean that one failure turns into exactly the marker."""
    return F.when(F.bool_and(ok), F.avg(x)).otherwise(failed)


def rates(values: Column, tasks: int, thresholds: tuple[float, ...] = (0.9, 0.0)) -> list[Column]:
    """Counts and the three rates (of all tasks, of valid rows, of all rows); ``values`` is null where a fit is invalid."""
    out = [F.count("*").alias("n_all"), F.count(values).alias("n_valid"), F.count_if(values.isNull()).alias("n_invalid")]
    for t in thresholds:
        hit = values >= t if t > 0 else values > t
        name = f"ge_{t:g}".replace(".", "_") if t > 0 else "positive"
        n = F.count_if(hit)
        out += [n.alias(f"n_{name}"), (n / F.lit(float(tasks))).alias(f"rate_tasks_{name}"), F.try_divide(n.cast("double"), F.count(values)).alias(f"rate_valid_{name}"), (n / F.count("*")).alias(f"rate_rows_{name}")]
    return out


def success_percent(values: Column, threshold: float) -> Column:
    """Of all rows; invalid ones count as failures."""
    return 100.0 * F.count_if(values >= threshold) / F.count("*")


def quantiles(values: Column, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> list[Column]:
    """Exact, linearly interpolated."""
    return [F.percentile(values, s).alias(f"q{round(100 * s):02d}") for s in shares]


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(keys, q10, q25, ...): the same numbers as ``quantiles``, for groups of any number of distinct values.

    Values are counted, the counts are summed up by ranges of (keys, value), and the rows that hold the ranks asked for are picked; no
    task holds a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    upto = sinks.between(running(counts, [*keys, "v_"], "upto_", "c_"))
    sizes = upto.groupBy(*keys).agg(F.sum("c_").alias("n_"), F.min(F.col("upto_") - F.col("c_")).alias("before_"))
    ranked = upto.join(sizes, keys)
    end = F.col("upto_") - F.col("before_")
    at = lambda rank: F.max(F.when((end > rank) & (end - F.col("c_") <= rank), F.col("v_")))
    picked, out = [F.max("n_").alias("n_")], []
    for s in shares:
        place = F.lit(s) * (F.col("n_") - 1)
        name = f"q{round(100 * s):02d}"
        picked += [at(F.floor(place)).alias(f"lo_{name}"), at(F.ceil(place)).alias(f"hi_{name}")]
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return ranked.groupBy(*keys).agg(*picked).select(*keys, *out)


def arg_max(df: DataFrame, keys: list[str], by: str, first: str) -> DataFrame:
    """The row of each group where ``by`` is largest; of equals, the one with the least ``first``. An aggregate, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(by), -F.col(first)))
    return df.filter(F.col(by).isNotNull()).groupBy(*keys).agg(best.alias("b_")).select(*keys, *(F.col(f"b_.{c}").alias(c) for c in rest))


def arg_min(df: DataFrame, by: str, first: str) -> DataFrame:
    """The row of the whole table where ``by`` is least."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(F.col(by), F.col(first))).alias("b_")).select("b_.*")


def histogram(df: DataFrame, value: str, edges: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n) for bins [e0, e1), ..., the last one closed; bin 0 holds what isn't finite or lies outside. Empty bins have a row."""
    v = F.col(value)
    expr = F.lit(0)
    for i in range(len(edges) - 1):
        upper = v <= edges[i + 1] if i == len(edges) - 2 else v < edges[i + 1]
        expr = F.when(finite(v) & (v >= edges[i]) & upper, i + 1).otherwise(expr)
    spark = df.sparkSession
    counted = df.groupBy(*keys, expr.alias("bin")).agg(F.count("*").alias("n"))
    spine = spark.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    if keys:
        spine = df.select(*keys).distinct().join(F.broadcast(spine))  # as many rows as there are edges
    return spine.join(counted, [*keys, "bin"], "left").select(*keys, F.col("bin").cast("long").alias("bin"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def equal_width(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, n) over ``bins`` equal bins, the last one closed; the limits are the data's own if not given."""
    if lo is None or hi is None:
        row = df.agg(F.min(value), F.max(value)).first()
        lo, hi = (row[0] if lo is None else lo), (row[1] if hi is None else hi)
    if lo is None or lo == hi:
        lo, hi = (lo or 0.0) - 0.5, (hi or 0.0) + 0.5
    v = F.col(value)
    at = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    counted = df.filter((v >= lo) & (v <= hi)).groupBy((at + 1).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def average_ranks(df: DataFrame, column: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ranks of ``column`` (in each group of ``keys``), equals sharing their mean rank.

    Equal values are counted first; the distinct ones are numbered by ranges of (keys, value), so no task orders a group. A group's ranks
    begin behind the count of the groups before it, which one aggregate gives.
    """
    counts = running(df.groupBy(*keys, column).agg(F.count("*").alias("c_")), [*keys, column], "upto_", "c_")
    if keys:
        counts = sinks.between(counts)
        first = counts.groupBy(*keys).agg(F.min(F.col("upto_") - F.col("c_")).alias("before_")).select(*(F.col(k).alias(f"{k}_b_") for k in keys), "before_")
        counts = counts.join(first, reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_b_")) for k in keys))).withColumn("upto_", F.col("upto_") - F.col("before_"))
    ranks = counts.select(*(F.col(k).alias(f"{k}_g_") for k in keys), F.col(column).alias("v_"), (F.col("upto_") - (F.col("c_") - 1) / 2.0).alias(name))
    same = reduce(and_, (df[k].eqNullSafe(F.col(f"{k}_g_")) for k in keys), df[column].eqNullSafe(F.col("v_")))
    return df.join(ranks, same).drop("v_", *(f"{k}_g_" for k in keys))


def correlation(x: str, y: str) -> Column:
    """Pearson's; null where a column is constant. By its parts, as ``corr`` ends a job where a column is constant."""
    size = F.stddev_pop(x) * F.stddev_pop(y)
    some = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (size > 0)
    return F.when(some, F.covar_pop(x, y) / F.when(size > 0, size))


def association(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, Pearson's r and Spearman's rho of the rows where both are present, and the two-sided p-values of both; by the groups of ``keys``.

    The rows are written first: ranks are joined by value, and a mean worked out again may differ in its last bit.
    """
    both = sinks.between(df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).filter(finite(F.col("x")) & finite(F.col("y"))))
    ranked = average_ranks(average_ranks(both, "x", "rx", keys), "y", "ry", keys)
    measures = (F.count("*").alias("n"), correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"))
    out = ranked.groupBy(*keys).agg(*measures) if keys else ranked.agg(*measures)
    return out.withColumns({"pearson_p": correlation_p(F.col("pearson"), F.col("n")), "spearman_p": correlation_p(F.col("spearman"), F.col("n"))})


def contingency(df: DataFrame, score: str, r2: str, high_score: float = 80.0, high_r2: float = 0.9) -> DataFrame:
    """Counts of low against high by the columns' means and the fixed limits, with both percentages of the high-R2 rows."""
    both = df.select(F.col(score).alias("s"), F.col(r2).alias("r")).filter(finite(F.col("s")) & finite(F.col("r")))
    means = both.agg(F.avg("s").alias("ms"), F.avg("r").alias("mr"))  # one row
    low_high, high_low, high = (F.col("r") < F.col("mr")) & (F.col("s") >= high_score), (F.col("r") >= high_r2) & (F.col("s") < F.col("ms")), F.col("r") >= high_r2
    return both.join(F.broadcast(means)).agg(
        F.count("*").alias("n"), F.count_if(low_high).alias("low_r2_high_score"), F.count_if(high_low).alias("high_r2_low_score"),
        (100.0 * F.count_if(high_low) / F.count("*")).alias("percent_of_rows"), F.try_divide(100.0 * F.count_if(high_low), F.count_if(high)).alias("percent_of_high_r2"),
    )


def survival(df: DataFrame, columns: list[str], steps: int = 400, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose worst column is at least t, for t = 0, 1/steps, ..., 1; a null column is worse than all.

    Each row falls into one step; the shares are running sums over steps + 1 rows, so rows never meet all thresholds.
    """
    from pyspark.sql import Window as W

    worst = F.least(*(F.coalesce(masked(F.col(c)), F.lit(float("-inf"))) for c in columns)) if len(columns) > 1 else F.coalesce(masked(F.col(columns[0])), F.lit(float("-inf")))
    # The last threshold that the row reaches; -1 for none. The array of one row keeps the worst column from being worked out for each use.
    w, guess = F.col("worst_"), F.col("guess_")
    at = F.when((guess < steps) & (w >= (guess + 1) / F.lit(float(steps))), guess + 1).when((guess >= 0) & (w < guess / F.lit(float(steps))), guess - 1).otherwise(guess).cast("long")
    rows = df.select(*keys, F.explode(F.array(worst)).alias("worst_")).withColumn("guess_", F.when(w >= 1.0, steps).when(w < 0, -1).otherwise(F.floor(w * steps)))
    counted = rows.groupBy(*keys, at.alias("step")).agg(F.count("*").alias("c_"))
    spine = df.sparkSession.range(-1, steps + 1).withColumnRenamed("id", "step")
    spine = df.select(*keys).distinct().join(F.broadcast(spine)) if keys else spine
    full = spine.join(counted, [*keys, "step"], "left").select(*keys, "step", F.coalesce("c_", F.lit(0)).alias("c_"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    above = F.sum("c_").over(part.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0))
    return full.select(*keys, "step", (F.col("step") / F.lit(float(steps))).alias("threshold"), (above / F.sum("c_").over(part)).alias("share")).filter("step >= 0")


def paired_delta(df: DataFrame, clean: str, noisy: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of noisy - clean where both are present, and how many noisy ones are missing."""
    d = F.col(noisy) - F.col(clean)
    return df.groupBy(*keys).agg(
        F.count(d).alias("valid_pair_count"), F.count_if(F.col(noisy).isNull()).alias("noisy_invalid_count"), F.percentile(d, 0.5).alias("median_delta_r2"),
        F.percentile(d, 0.1).alias("q10_delta_r2"), F.percentile(d, 0.9).alias("q90_delta_r2"), F.avg((d > 0).cast("double")).alias("fraction_delta_positive"),
    )


def valid_metric(x: Column) -> Column:
    """Present, finite and no failure sentinel."""
    return finite(x) & (F.abs(x) < FAILED)


def acceptance(df: DataFrame, keys: list[str], accepted: str = "accepted", proposed: str = "proposed") -> DataFrame:
    rate = F.col(accepted) / F.col(proposed)
    return df.groupBy(*keys).agg((F.sum(accepted) / F.sum(proposed)).alias("rate"), F.min(rate).alias("least"), F.max(rate).alias("most"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
