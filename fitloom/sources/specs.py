"""Checks of a metadata sheet, row by row, before anything is made from it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions.cells import IDENTIFIER, NOTHING, NUMBER, RANGE, literal_cell, normal_id
from fitloom.functions.expr import FormulaError, parse
from fitloom.operators.relational import require_columns
from fitloom.sources import sinks

COLUMNS = ("ID", "GenerationFormula", "Target", "IndependentVars", "ParameterRange", "FixedConstantValues", "paraValue", "varRange")


def parts(text: str | None) -> list[str]:
    text = (text or "").strip()
    return [] if text.lower() in NOTHING else [p.strip() for p in re.split("[,;]", text) if p.strip()]


def numbers(value: object, message: str) -> list[float]:
    if not isinstance(value, list | tuple) or not all(isinstance(x, int | float) and math.isfinite(x) for x in value):
        raise ValueError(message)
    return list(value)


def check(row: dict[str, str | None], groups: int) -> None:
    """A ValueError that says what is wrong with the row, if anything is."""
    name = (row["ID"] or "").strip()
    if not name or name in (".", "..") or re.search(r"[/\\\0]", name):
        raise ValueError(f"ID is no folder name: {name!r}")
    variables = parts(row["IndependentVars"])
    if not variables or len(set(variables)) < len(variables) or not all(re.match(IDENTIFIER, v) for v in variables):
        raise ValueError("IndependentVars is no list of distinct names")
    if not re.match(IDENTIFIER, (row["Target"] or "").strip()):
        raise ValueError("Target is no name")
    found = re.findall(RANGE, row["ParameterRange"] or "")
    if any(not float(lo) < float(hi) for _, lo, hi in found):
        raise ValueError("ParameterRange has an empty range")
    constants = []
    for part in parts(row["FixedConstantValues"]):
        key, _, value = part.partition("=")
        if not re.match(IDENTIFIER, key.strip()) or not re.fullmatch(NUMBER, value.strip()):
            raise ValueError(f"FixedConstantValues: {part!r} is no constant")
        constants.append(key.strip())
    every = variables + [n for n, _, _ in found] + constants
    if len(set(every)) < len(every):
        raise ValueError("a name stands for two of variables, parameters and constants")
    try:
        vectors, areas = literal_cell(row["paraValue"] or ""), literal_cell(row["varRange"] or "")
    except (SyntaxError, ValueError) as e:
        raise ValueError("paraValue or varRange is no list") from e
    if len(vectors) < groups or any(len(numbers(v, "paraValue has something else than numbers")) != len(found) for v in vectors):
        raise ValueError(f"paraValue is not {groups} vectors of {len(found)} numbers")
    if len(areas) < groups or any(not isinstance(g, list | tuple) or len(g) != len(variables) for g in areas):
        raise ValueError(f"varRange is not {groups} groups of {len(variables)} ranges")
    for lo_hi in (numbers(r, "varRange has something else than numbers") for g in areas for r in g):
        if len(lo_hi) != 2 or not lo_hi[0] <= lo_hi[1]:
            raise ValueError("varRange has an empty range")
    try:
        parse(row["GenerationFormula"] or "", None, set(every))
    except FormulaError as e:
        raise ValueError(f"GenerationFormula: {e}") from e


def spec_errors(sheet: DataFrame, groups: int = 8) -> DataFrame:
    """(row, ID, problem) of each row that can't be used; rows are counted as in the workbook, where the header is row 1."""
    require_columns(sheet, list(COLUMNS), "the sheet")
    # Written with their places, so that counts and rows are sure to have the same. A place is the partition's number and one within it.
    rows = sinks.between(sheet.select(*(F.col(c).cast("string").alias(c) for c in COLUMNS), F.monotonically_increasing_id().alias("at_"), normal_id(F.col("ID").cast("string")).alias("key_")))
    part = F.shiftright("at_", 33)
    counts = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("c_"))  # a row a partition
    before = counts.select("part_", F.coalesce(F.sum("c_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    twice = rows.groupBy("key_").agg(F.min("at_").alias("first_"), F.count("*").alias("c_")).filter("c_ > 1").select(F.col("key_").alias("twice_"), "first_")
    placed = rows.join(F.broadcast(before), part == F.col("part_")).withColumn("row", (F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before_") + 2).cast("int"))
    n = int(sheet.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = placed.join(twice, F.col("key_").eqNullSafe(F.col("twice_")), "left").withColumn("nth_", F.when(F.col("at_") > F.col("first_"), 2).otherwise(1)).select(*COLUMNS, "row", "nth_").repartition(n)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    if r["nth_"] > 1:
                        raise ValueError("ID occurs twice")
                    check(r, groups)
                except ValueError as e:
                    out.append((r["row"], r["ID"], str(e)))
            yield pd.DataFrame(out, columns=["row", "ID", "problem"])

    return numbered.mapInPandas(judge, "row int, ID string, problem string")
