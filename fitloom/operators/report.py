"""What figures and report tables show, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions import scalars
from fitloom.operators import metrics
from fitloom.operators.relational import all_negative, common_keys, on_spine, task_spine, unpivot

# The tasks of the benchmark, limits of success, and edges of the bins.
TASKS = 59
SUCCESS = (0.9, 0.95, 0.99)
R2_EDGES = [float("-inf"), 0.0, 0.9, 0.99, 0.9999, 1.0, float("inf")]
STRUCTURE_EDGES = [0.0, 45.0, 75.0, 90.0, 100.0000001]
TEST_LEVELS = {"0": 0.0, "001": 0.01, "003": 0.03, "005": 0.05, "01": 0.1}


def long_robustness(tables: dict[float, DataFrame], columns: dict[float, str]) -> DataFrame:
    """(ID, train_noise, test_noise, r2) for the IDs that all tables have; sentinels are null."""
    from functools import reduce

    shared = common_keys(list(tables.values()), "ID")
    parts = []
    for train, df in tables.items():
        wide = df.join(shared, "ID", "left_semi").select("ID", *(scalars.masked(F.col(c)).alias(str(level)) for level, c in columns.items()))
        parts.append(unpivot(wide, ["ID"], [str(level) for level in columns], "t_", "r2").select("ID", F.lit(float(train)).alias("train_noise"), F.col("t_").cast("double").alias("test_noise"), "r2"))
    return reduce(DataFrame.unionByName, parts)


def robustness_summary(long: DataFrame, tasks: int = TASKS) -> DataFrame:
    r = F.col("r2")
    high, positive = F.count_if(r >= 0.9), F.count_if(r > 0)
    return long.groupBy("train_noise", "test_noise").agg(
        F.count("*").alias("common_id_count"), F.count("r2").alias("valid_count"), F.count_if(r.isNull()).alias("invalid_count"),
        F.percentile(r, 0.5).alias("median_r2"), F.percentile(r, 0.1).alias("q10_r2"), F.percentile(r, 0.25).alias("q25_r2"), F.percentile(r, 0.75).alias("q75_r2"),
        high.alias("high_accuracy_count"), (high / F.lit(float(tasks))).alias("high_accuracy_rate"), positive.alias("positive_r2_count"), (positive / F.lit(float(tasks))).alias("positive_r2_rate"),
    )


def perfect_summary(table: DataFrame, columns: dict[float, str]) -> DataFrame:
    """Of the true formulas, without rows that are negative throughout."""
    good = table.filter(~all_negative(list(columns.values())))
    long = unpivot(good.select("ID", *(scalars.masked(F.col(c)).alias(str(level)) for level, c in columns.items())), ["ID"], [str(level) for level in columns], "t_", "r2")
    r = F.col("r2")
    return long.groupBy(F.col("t_").cast("double").alias("test_noise")).agg(
        F.percentile(r, 0.5).alias("median_r2"), F.percentile(r, 0.1).alias("q10_r2"), F.percentile(r, 0.25).alias("q25_r2"), F.percentile(r, 0.75).alias("q75_r2"),
        (F.count_if(r >= 0.9) / F.count("*")).alias("high_accuracy_rate"), (F.count_if(r > 0) / F.count("*")).alias("positive_r2_rate"),
    )


def paired_summary(long: DataFrame) -> DataFrame:
    """Noisy training against clean training, by test noise."""
    clean = long.filter("train_noise = 0").select("ID", "test_noise", F.col("r2").alias("clean"))
    noisy = long.filter("train_noise > 0").select("ID", "train_noise", "test_noise", F.col("r2").alias("noisy"))
    return metrics.paired_delta(noisy.join(clean, ["ID", "test_noise"]), "clean", "noisy", ("train_noise", "test_noise"))


def paired_points(long: DataFrame) -> DataFrame:
    clean = long.filter("train_noise = 0").select("ID", "test_noise", F.col("r2").alias("clean"))
    return long.filter("train_noise > 0").select("ID", "train_noise", "test_noise", F.col("r2").alias("noisy")).join(clean, ["ID", "test_noise"]).withColumn("delta", F.col("noisy") - F.col("clean")).withColumn("failed", F.col("noisy").isNull())


def worst_case_survival(long: DataFrame, steps: int = 400) -> DataFrame:
    worst = long.groupBy("train_noise", "ID").agg(F.min(F.coalesce("r2", F.lit(float("-inf")))).alias("worst"))
    return metrics.survival(worst.withColumn("worst", F.when(F.col("worst") > float("-inf"), F.col("worst"))), ["worst"], steps, ("train_noise",))


def coverage(df: DataFrame, columns: dict[float, str]) -> DataFrame:
    """(test_noise, valid, tasks, q25, median, q75): the noise profile of one method, failed evaluations left out of the quantiles."""
    long = unpivot(df.select("ID", *(scalars.masked(F.col(c)).alias(str(level)) for level, c in columns.items())), ["ID"], [str(level) for level in columns], "t_", "r2")
    r = F.col("r2")
    return long.groupBy(F.col("t_").cast("double").alias("test_noise")).agg(F.count(r).alias("valid"), F.count("*").alias("tasks"), *(F.percentile(r, s).alias(n) for s, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))))


def profile(summary: DataFrame) -> DataFrame:
    return summary.select("train_noise", "test_noise", "median_r2", "q25_r2", "q75_r2", "high_accuracy_rate", "positive_r2_rate")


def structure_levels(df: DataFrame, score: str) -> DataFrame:
    """Bin 0: failed or missing, then below 45, 75, 90 and up to 100. A score above 100 is an error."""
    over = F.when(F.col(score) > 100, F.raise_error(F.lit("a structural score exceeds 100")).cast("double")).otherwise(F.col(score))
    return metrics.histogram(df.withColumn(score, F.when(over >= 0, over)), score, STRUCTURE_EDGES)


def r2_levels(df: DataFrame, r2: str) -> DataFrame:
    """Bin 0: failed; then below 0, 0.9, 0.99, 0.9999, and up to 1. R2 above 1 is an error."""
    over = F.when(F.col(r2) > 1, F.raise_error(F.lit("R2 exceeds 1")).cast("double")).otherwise(scalars.masked(F.col(r2)))
    return metrics.histogram(df.withColumn(r2, over), r2, R2_EDGES)


def level_statistics(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(level, median, q25, q75, valid, success by limit): success is of all rows, quantiles of valid ones."""
    wide = df.select("ID", *(scalars.masked(F.col(c)).alias(level) for level, c in columns.items()))
    long = unpivot(wide, ["ID"], list(columns), "level", "r2")
    r = F.col("r2")
    return long.groupBy("level").agg(F.percentile(r, 0.5).alias("median"), F.percentile(r, 0.25).alias("q25"), F.percentile(r, 0.75).alias("q75"), F.count("r2").alias("valid"), *(metrics.success_percent(r, t).alias(f"success_{round(100 * t)}") for t in SUCCESS))


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means without rows that are negative throughout; R2 as 1 - mean NMSE."""
    good = df.filter(~all_negative(columns))
    return good.agg(*((1.0 - F.avg(scalars.nmse_of(scalars.masked(F.col(c))))).alias(c) for c in columns))


def density(df: DataFrame, key: str, score: str, r2: str) -> DataFrame:
    """(key, score, nmse, near): each point with the number of points within 5 of score and a decade of NMSE, drawn thinnest first."""
    from fitloom.operators.relational import band_counts

    points = df.filter(scalars.finite(F.col(r2)) & scalars.finite(F.col(score))).select(key, score, scalars.nmse_of(scalars.masked(F.col(r2))).alias("nmse")).filter("nmse is not null").withColumn("log_nmse", F.log10("nmse"))
    return points.join(band_counts(points, key, score, "log_nmse"), key).select(key, score, "nmse", "near").orderBy("near", key)


def heatmap(df: DataFrame, columns: list[str], tasks: int = TASKS) -> DataFrame:
    """All tasks by all columns, in [0, 1]; failed ones are 0."""
    full = on_spine(df.select("ID", *columns), task_spine(df.sparkSession, tasks), "ID")
    return full.select("ID", *(scalars.clipped(F.col(c), 0.0, 1.0).alias(c) for c in columns))


def dot_plot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series, ID, r2 at least 0, strength) with the mean of each series."""
    from pyspark.sql import Window as W

    long = unpivot(df.select("ID", *(scalars.masked(F.col(c)).alias(c) for c in columns)), ["ID"], columns, "series", "r2").withColumn("r2", F.greatest("r2", F.lit(0.0)))
    return long.withColumn("strength", scalars.strength(F.col("r2"))).withColumn("mean_r2", F.avg("r2").over(W.partitionBy("series")))


def complexity_points(df: DataFrame, r2: str) -> DataFrame:
    return df.select("ID", "complexity", scalars.masked(F.col(r2)).alias("r2")).withColumn("outlier", F.coalesce(F.col("r2") < 0, F.lit(False)))


def least_r2(df: DataFrame, r2: str) -> DataFrame:
    """The least valid R2, which sets the panel of outliers; one row."""
    return df.agg(F.min(scalars.masked(F.col(r2))).alias("least"), F.count_if(scalars.masked(F.col(r2)) < 0).alias("negative"))


def overview(df: DataFrame, score: str, noise: dict[str, str], shifts: dict[str, str], tasks: int = TASKS) -> DataFrame:
    """(statistic, level, value): the key numbers of a benchmark run, medians of structure and of R2 by condition, and successes of all tasks."""
    from functools import reduce

    s = F.when(scalars.finite(F.col(score)) & (F.col(score) >= 0), F.col(score))
    facts = [
        df.select(F.lit("tasks").alias("statistic"), F.lit("").alias("level"), F.lit(float(tasks)).alias("value")).limit(1),
        df.agg(F.count_if(s >= 80).cast("double").alias("value")).select(F.lit("similarity of 80 or more").alias("statistic"), F.lit("").alias("level"), "value"),
        df.agg(F.median(s).alias("value")).select(F.lit("median similarity").alias("statistic"), F.lit("").alias("level"), "value"),
    ]
    for kind, columns in (("noise", noise), ("shift", shifts)):
        if columns:
            by = level_statistics(df, columns)
            facts += [by.select(F.lit(f"{kind} median R2").alias("statistic"), "level", F.col("median").alias("value")), by.select(F.lit(f"{kind} success percent").alias("statistic"), "level", F.col("success_90").alias("value"))]
    return reduce(DataFrame.unionByName, facts)


def success_comparison(tables: dict[str, DataFrame], r2: str, tasks: int = TASKS) -> DataFrame:
    from functools import reduce

    parts = [df.select(F.lit(name).alias("method"), scalars.masked(F.col(r2)).alias("r2")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("method").agg(*metrics.rates(F.col("r2"), tasks))


def metric_report(df: DataFrame, unique_by: str, score: str, r2: str) -> dict[str, DataFrame]:
    """Best row of each key with R2 of at least 0: association, contingency and both histograms, with the part near 1 on a log scale."""
    both = df.filter(scalars.finite(F.col(score)) & scalars.finite(F.col(r2)))
    best = metrics.arg_max(both.withColumn("o_", F.xxhash64(*both.columns)), [unique_by], r2, "o_").drop("o_").filter(F.col(r2) >= 0)
    near = best.filter((F.col(r2) > 0.9) & (F.col(r2) <= 1)).select(F.log(F.col(r2) - 0.9).alias("log_r2"))
    return {
        "rows": best, "association": metrics.association(best, score, r2), "contingency": metrics.contingency(best, score, r2), "medians": best.agg(F.median(score).alias(score), F.median(r2).alias(r2)),
        "score_histogram": metrics.equal_width(best, score, 20, 0.0, 100.0), "r2_histogram": metrics.equal_width(best, r2, 20, 0.0, 1.0), "log_histogram": metrics.equal_width(near, "log_r2", 10),
    }
