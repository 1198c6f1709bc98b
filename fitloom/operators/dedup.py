"""Equivalent formulas: each distinct text is brought to its canonical key once, then rows point to the first of their class."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import canonical
from fitloom.functions.expr import parse
from fitloom.operators.ordering import running
from fitloom.sources import sinks

KEYS = "text_key string, symbol_key string, exact_key string, probe_key string, parsed boolean"


def with_text_key(df: DataFrame, formula: str) -> DataFrame:
    """The cheap key: no left side, no white space, ``**`` for ``^``."""
    right = F.regexp_replace(F.coalesce(F.col(formula), F.lit("")), r"^[^=]*=", "")
    return df.withColumn("text_key", F.regexp_replace(F.regexp_replace(right, r"\s+", ""), r"\^", "**"))


def formula_keys(formulas: DataFrame, formula: str) -> DataFrame:
    """(text_key, symbol_key, exact_key, probe_key, parsed) of the distinct texts of all files together."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [canonical.keys(t) for t in part["text_key"]]
            yield pd.DataFrame({"text_key": part["text_key"], "symbol_key": [k[0] for k in found], "exact_key": [k[1] for k in found], "probe_key": [k[2] for k in found], "parsed": [k[3] for k in found]})

    return with_text_key(formulas, formula).filter("text_key <> ''").select("text_key").distinct().mapInPandas(of, KEYS)


def exact_pointers(df: DataFrame, order: str, formula: str) -> DataFrame:
    """(order, eq_id, redundant) over one large file: eq_id counts the whole table in its order, redundant points to the first row of the
    same cheap key. Texts are known by 128 bits of hash, so no text is shuffled; rows without a formula stand for themselves."""
    text = F.col("text_key")
    keyed = with_text_key(df.select(order, formula), formula).select(order, (text == "").alias("none_"), F.xxhash64(text).alias("h1_"), F.xxhash64(F.lit(1), text).alias("h2_"))
    ids = sinks.between(running(keyed, [order], "eq_id"))
    first = ids.filter("not none_").groupBy("h1_", "h2_").agg(F.min("eq_id").alias("first_"))
    some = ids.filter("not none_").join(first, ["h1_", "h2_"]).select(order, "eq_id", F.when(F.col("first_") == F.col("eq_id"), 0).otherwise(F.col("first_")).cast("long").alias("redundant"))
    return some.unionByName(ids.filter("none_").select(order, "eq_id", F.lit(0).cast("long").alias("redundant")))


def mark(formulas: DataFrame, formula: str, file: str = "file", row: str = "row_idx", compare: bool = True) -> DataFrame:
    """``formulas`` with ``eq_id`` (1.. in row order of each file) and ``redundant`` (0, or the eq_id of the first equivalent row).

    An empty formula stands for itself. Rows with one exact key are one class by an aggregate. With ``compare`` classes of one file, symbol
    set and probe key are verified by their probes, each worked out once; all others are settled by their keys.
    """
    numbered = with_text_key(formulas, formula).withColumn("eq_id", F.row_number().over(W.partitionBy(file).orderBy(row)).cast("long"))
    keyed = numbered.join(formula_keys(formulas, formula), "text_key", "left")
    own = F.when(F.col("text_key") == "", F.concat(F.lit("row: "), F.col("eq_id").cast("string"))).otherwise(F.col("exact_key"))
    keyed = keyed.withColumn("exact_key", own).fillna("", ["symbol_key", "probe_key"])
    block, klass = [file, "symbol_key", "probe_key"], [file, "symbol_key", "exact_key"]
    # A class has the probes of its first row: a form may have several domains.
    first = keyed.groupBy(*klass).agg(F.min("eq_id").alias("first"), F.min_by("text_key", "eq_id").alias("text"), F.min_by("probe_key", "eq_id").alias("probe_key"), F.max(F.coalesce("parsed", F.lit(False))).alias("parsed"))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        probes, out = [], []
        for key, at, text in part.sort_values("first")[["exact_key", "first", "text"]].itertuples(index=False):
            p = canonical.probe(parse(text))
            found = next((i for q, i in probes if canonical.agree(q, p)), at)
            if found == at:
                probes.append((p, at))
            out.append((part[file].iloc[0], part["symbol_key"].iloc[0], key, found))
        return pd.DataFrame(out, columns=[*klass, "leader"])

    if compare:
        kinds = f"{file} {formulas.schema[file].dataType.simpleString()}, symbol_key string, exact_key string, leader long"
        counted = first.withColumn("n", F.count("*").over(W.partitionBy(*block))).withColumn("some", F.col("parsed") & (F.col("n") > 1))
        merged = counted.filter("some").groupBy(*block).applyInPandas(merge, kinds)
        classes = merged.unionByName(counted.filter("not some").select(*klass, F.col("first").alias("leader")))
    else:
        classes = first.select(*klass, F.col("first").alias("leader"))
    out = keyed.join(classes, klass, "left")
    return out.select(*formulas.columns, "eq_id", F.when(F.col("leader") == F.col("eq_id"), 0).otherwise(F.coalesce("leader", F.lit(0))).cast("long").alias("redundant"))


def mark_candidates(candidates: DataFrame, formula: str, keys: list[str], row: str) -> DataFrame:
    """The 0/1 flag inside a candidate set; rows that are already marked stay marked and represent nobody."""
    name = "k_"
    whole = candidates.withColumn(name, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))
    free = whole.filter(F.coalesce(F.col("redundant"), F.lit(0)) == 0).drop("redundant")
    marked = mark(free, formula, name, row).withColumn("redundant", (F.col("redundant") > 0).cast("long")).drop("eq_id")
    kept = whole.filter(F.coalesce(F.col("redundant"), F.lit(0)) > 0).withColumn("redundant", F.col("redundant").cast("long"))
    return marked.unionByName(kept).drop(name)


def check_marks(marked: DataFrame, file: str = "file") -> DataFrame:
    """Rows that break the rules of a processed file: ids 1..n, pointers to smaller ids, pointers to representatives. Empty if all is well."""
    w = W.partitionBy(file)
    gaps = marked.withColumn("n_", F.count("*").over(w)).withColumn("d_", F.row_number().over(w.orderBy("eq_id")))
    numbers = gaps.filter((F.col("d_") != F.col("eq_id")) | (F.col("eq_id") > F.col("n_"))).select(file, "eq_id", F.lit("ids are not 1..n").alias("problem"))
    later = marked.filter(F.col("redundant") >= F.col("eq_id")).select(file, "eq_id", F.lit("points to no smaller id").alias("problem"))
    leaders = marked.filter("redundant = 0").select(file, F.col("eq_id").alias("redundant"))
    lost = marked.filter("redundant > 0").join(leaders, [file, "redundant"], "left_anti").select(file, "eq_id", F.lit("points to no representative").alias("problem"))
    return numbers.unionByName(later).unionByName(lost)


def statistics(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("rows"), F.count_if(F.col("redundant") == 0).alias("representatives"), F.count_if(F.col("redundant") > 0).alias("redundant"))
