"""Programs in rows against columns of a plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fitloom.functions import compile as comp
from fitloom.functions import program
from fitloom.functions.expr import BINARY, UNARY, Name, Num, Op, parse, show

NUMBERS = [-2.5, -1.0, -0.3, 0.0, 0.4, 1.0, 3.0, float("nan"), float("inf"), -float("inf")]
KINDS = ["+", "-", "*", "/", "**"]


def plain(v):
    return None if v is None else "nan" if math.isnan(v) else v


def both(spark, texts, rows):
    """{(formula, row): (value of the program, value of the plan)}."""
    data = spark.createDataFrame(rows, "i int, x double, y double")
    formulas = program.programs(spark.createDataFrame([(t,) for t in texts], "formula string"), ["x", "y"])
    run = data.join(F.broadcast(formulas)).select("i", "formula", program.value(F.col("program"), F.array("x", "y")).alias("v"))
    found = {(r["formula"], r["i"]): plain(r["v"]) for r in run.collect()}
    names = {"x": F.col("x"), "y": F.col("y")}
    plan = data.select("i", *(comp.to_column(parse(t), names).cast("double").alias(f"c{k}") for k, t in enumerate(texts))).collect()
    return {(t, r["i"]): (found[t, r["i"]], plain(r[f"c{k}"])) for k, t in enumerate(texts) for r in plan}


@pytest.mark.parametrize("texts", [[f"{f}(x)" for f in UNARY] + ["-x", "pi + e", "x"], [f"x {k} y" for k in KINDS] + [f"{f}(x, y)" for f in BINARY] + ["x % y", "x^y"]])
def test_each_function(spark, texts):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in NUMBERS for b in NUMBERS)]
    wrong = {k: v for k, v in both(spark, texts, rows).items() if v[0] != v[1]}
    assert not wrong, list(wrong.items())[:5]


def test_random_trees(spark):
    rng = random.Random(4)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([Name("x"), Name("y"), Num(round(rng.uniform(-3, 3), 2))])
        if rng.random() < 0.4:
            return Op(rng.choice(UNARY), (grow(depth - 1),))
        return Op(rng.choice(KINDS), (grow(depth - 1), grow(depth - 1)))

    texts = list(dict.fromkeys(show(grow(5)) for _ in range(40)))
    rows = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(20)]
    wrong = {k: v for k, v in both(spark, texts, rows).items() if v[0] != v[1]}
    assert not wrong, list(wrong.items())[:5]


def test_what_is_no_formula(spark):
    df = spark.createDataFrame([("x +",), ("z",), (None,), ("lambda*x",), ("x",), ("e",)], "formula string")
    out = program.programs(df, ["x"], constants={"lambda": 2.0, "e": 5.0}).select("formula", program.value(F.col("program"), F.array(F.lit(None).cast("double"))).alias("v"))
    assert {r["formula"]: plain(r["v"]) for r in out.collect()} == {"x +": None, "z": None, None: None, "lambda*x": "nan", "x": "nan", "e": 5.0}


def test_no_python_beside_the_formulas(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.expr("array(named_struct('op', 1, 'x', 0D), named_struct('op', 0, 'x', 2D))").alias("p"))
    plan = df.select(program.value(F.col("p"), F.array("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
