"""Formulas as data: programs in an array column, run by a stack machine made of built-in functions.

A plan of Catalyst columns is a formula's own; here one plan serves a table of formulas. A formula's text becomes a list of instructions in
postfix order, once a formula. ``value`` folds the list of each row over a stack, so n formulas meet m rows by a join, in the JVM, without
a plan a formula and without Python. The rules of numbers are those of ``compile``: IEEE results, NaN where no real value exists.

An instruction is (op, x): op 0 puts the number x on the stack, op 1 the x-th of the row's values, others take one or two numbers off it and put
their result on it. A formula that can't be read, or that names what is not there, has no program; its value is null. A null in
``values`` is NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.functions.compile import COLUMN_FUNCTIONS, divide
from fitloom.functions.expr import CONSTANTS, FormulaError, Name, Node, Num, parse, protect_powers

NUMBER, VALUE = 0, 1
BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "**": F.pow, "mod": COLUMN_FUNCTIONS["mod"], "ppow": COLUMN_FUNCTIONS["ppow"]}
UNARY = {"neg": lambda a: -a} | {k: f for k, f in COLUMN_FUNCTIONS.items() if k not in BINARY}
CODES = {kind: i for i, kind in enumerate([*BINARY, *UNARY], 2)}
#: Below it an operator takes two numbers.
FIRST_UNARY = 2 + len(BINARY)
PROGRAM = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("x", T.DoubleType())]))


def instructions(tree: Node, names: list[str], constants: dict[str, float] | None = None) -> list[tuple[int, float]]:
    """The postfix program of a tree. ``names`` are the row's values in order; they stand before the constants."""
    fixed, place, out = CONSTANTS | (constants or {}), {n: i for i, n in enumerate(names)}, []

    def go(n: Node) -> None:
        if isinstance(n, Num):
            out.append((NUMBER, n.value))
        elif isinstance(n, Name):
            if n.id in place:
                out.append((VALUE, float(place[n.id])))
            elif n.id in fixed:
                out.append((NUMBER, float(fixed[n.id])))
            else:
                raise FormulaError(f"unknown name {n.id}")
        else:
            for a in n.args:
                go(a)
            out.append((CODES[n.kind], 0.0))

    go(tree)
    return out


def programs(formulas: DataFrame, names: list[str], formula: str = "formula", constants: dict[str, float] | None = None, protected: bool = False, name: str = "program") -> DataFrame:
    """``formulas`` with their programs, null where a text is no formula of ``names`` and the constants."""
    kinds = T.StructType([*formulas.schema.fields, T.StructField(name, PROGRAM)])

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> list[dict] | None:
            try:
                tree = parse(text or "")
                return [{"op": op, "x": x} for op, x in instructions(protect_powers(tree) if protected else tree, names, constants)]
            except (FormulaError, RecursionError):
                return None

        for part in parts:
            yield part.assign(**{name: [one(t) for t in part[formula]]})

    return formulas.mapInPandas(of, kinds)


def value(program: Column, values: Column) -> Column:
    """What the program makes of the row's ``values`` (an array of doubles)."""

    def run(stack: Column, step: Column) -> Column:
        op, n = step["op"], F.size(stack)
        top, under = F.get(stack, n - 1), F.get(stack, n - 2)
        out = F.when(op == NUMBER, step["x"]).when(op == VALUE, F.coalesce(F.get(values, step["x"].cast("int")), F.lit(float("nan"))))
        for kind, f in BINARY.items():
            out = out.when(op == CODES[kind], f(under, top))
        for kind, f in UNARY.items():
            out = out.when(op == CODES[kind], f(top))
        taken = F.when(op < 2, 0).when(op < FIRST_UNARY, 2).otherwise(1)
        return F.concat(F.slice(stack, F.lit(1), n - taken), F.array(out.cast("double")))

    return F.aggregate(program, F.array().cast("array<double>"), run, lambda stack: F.get(stack, F.lit(0)))
