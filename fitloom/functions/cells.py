"""Cells of metadata sheets to typed columns. Text in, arrays, maps and numbers out; strict forms raise when they are read."""

from __future__ import annotations

import ast
import math
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions import expr

# Cells that mean "nothing", and the patterns of names, numbers and ranges.
NOTHING = ("", "none", "(none)", "nan")
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
RANGE = rf"([A-Za-z_]\w*)\s*(?:=|in\s)\s*\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]"
PAIR = "struct<lo:double,hi:double>"


def must(ok: Column, value: Column, message: str, *shown: Column) -> Column:
    """``value``, or an error when a row is not ok."""
    text = F.concat_ws(" ", F.lit(message), *(s.cast("string") for s in shown))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text))


def blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*NOTHING)


def names(c: Column, separators: str = "[,;]") -> Column:
    """Trimmed parts; none at all for cells that mean nothing."""
    return F.when(blank(c), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(c, separators), lambda x: F.trim(x)), lambda x: x != ""))


def strict_names(c: Column) -> Column:
    """At least one, all identifiers, none twice."""
    found = names(c)
    ok = (F.size(found) > 0) & (F.size(F.array_distinct(found)) == F.size(found)) & F.forall(found, lambda x: x.rlike(IDENTIFIER))
    return must(ok, found, "not a list of distinct names:", c)


def range_names(c: Column) -> Column:
    """Names of ``a=[lo,hi], b in [lo,hi]``, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RANGE), F.lit(1))


def ranges(c: Column, strict: bool = False) -> Column:
    """(name, lo, hi) in order; strict: all lo < hi."""
    text = F.coalesce(c, F.lit(""))
    part = lambda i: F.regexp_extract_all(text, F.lit(RANGE), F.lit(i))
    out = F.transform(F.arrays_zip(part(1).alias("name"), part(2).alias("lo"), part(3).alias("hi")), lambda x: F.struct(x["name"].alias("name"), x["lo"].cast("double").alias("lo"), x["hi"].cast("double").alias("hi")))
    return must(F.forall(out, lambda x: x["lo"] < x["hi"]), out, "a range is empty:", c) if strict else out


def constants(c: Column) -> Column:
    """``c=1.5; g=9.81 m/s^2``: the leading number of each; parts without one are left out."""
    parts = F.filter(F.transform(names(c), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_extract(x, rf"=\s*({NUMBER})", 1).alias("v"))), lambda x: (x["v"] != "") & (x["k"] != ""))
    return F.map_from_arrays(F.transform(parts, lambda x: x["k"]), F.transform(parts, lambda x: x["v"].cast("double")))


def constant_order(c: Column) -> Column:
    return F.transform(F.filter(names(c), lambda x: x.contains("=")), lambda x: F.trim(F.substring_index(x, "=", 1)))


def strict_constants(c: Column) -> Column:
    """Each part ``name=number`` with nothing behind the number; names once."""
    whole = F.forall(names(c), lambda x: x.rlike(rf"^[A-Za-z_]\w*\s*=\s*{NUMBER}$"))
    order = constant_order(c)
    ok = whole & (F.size(F.array_distinct(order)) == F.size(order))
    return F.when(F.coalesce(ok, F.lit(True)), constants(c)).otherwise(must(ok, constants(c), "not a list of constants:", c))


def json_cell(c: Column, kind: str = "array<array<double>>") -> Column:
    return F.from_json(c, kind)


def literal_list(c: Column, kind: str = "array<array<double>>") -> Column:
    """A Python list or tuple of numbers."""
    return F.from_json(F.translate(F.regexp_replace(c, r",\s*([\])])", "$1"), "()'", '[]"'), kind)


def vectors(c: Column, groups: int, dim: Column | int, exact: bool = True) -> Column:
    """Parameter vectors: ``groups`` (or more, if not exact) of ``dim`` finite numbers."""
    out = literal_list(c)
    dim = F.lit(dim) if isinstance(dim, int) else dim
    ok = (F.size(out) == groups if exact else F.size(out) >= groups) & F.forall(out, lambda v: (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    return must(ok, out, "parameter vectors don't fit:", c)


def variable_ranges(c: Column, groups: int, dim: Column | int) -> Column:
    """groups x variables of (lo, hi) with lo < hi."""
    raw = literal_list(c, "array<array<array<double>>>")
    dim = F.lit(dim) if isinstance(dim, int) else dim
    ok = (F.size(raw) == groups) & F.forall(raw, lambda g: (F.size(g) == dim) & F.forall(g, lambda r: (F.size(r) == 2) & (F.get(r, 0) < F.get(r, 1))))
    return must(ok, pairs(raw), "variable ranges don't fit:", c)


def pairs(raw: Column) -> Column:
    return F.transform(raw, lambda g: F.transform(g, lambda r: F.struct(F.get(r, 0).alias("lo"), F.get(r, 1).alias("hi"))))


def parameter_list(c: Column) -> Column:
    """``[p0, p1]``, ``['p0']``, ``p0,p1`` or ``[]``."""
    return names(F.regexp_replace(c, r"[\[\]'\"()\s]", ""), ",")


def initial_values(text: str | None, symbols: bool = True) -> list[float]:
    """``[1.5, -1/2, pi]``: numbers and arithmetic of numbers; names of constants only with ``symbols``."""
    from fitloom.functions.compile import to_numpy

    body = (text or "").strip().strip("[]()")
    if not body:
        return []
    out = []
    for part in body.split(","):
        tree = expr.parse(part.strip().strip("'\""))
        kinds = {n.kind for n in expr.walk(tree) if isinstance(n, expr.Op)}
        if expr.names(tree) and not symbols or kinds - {"+", "-", "*", "/", "**", "neg"}:
            raise expr.FormulaError(f"not a number: {part.strip()}")
        value = float(to_numpy(tree, [])())
        if not math.isfinite(value):
            raise expr.FormulaError(f"not finite: {part.strip()}")
        out.append(value)
    return out


def initial_column(c: Column, symbols: bool = True) -> Column:
    """``initial_values`` of each row."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: initial_values(t, symbols))

    return of(c)


def named_values(names_: Column, values: Column) -> Column:
    """A map of names and the vector that belongs to them; they must be equally many."""
    return must(F.size(names_) == F.size(values), F.map_from_arrays(names_, values), "names and values don't fit:", F.size(names_), F.size(values))


def literal_cell(text: str) -> list:
    """A list written as JSON or as a Python literal, on the driver."""
    value = ast.literal_eval(text)
    if not isinstance(value, list | tuple):
        raise ValueError(f"not a list: {text!r}")
    return list(value)


def index_spec(text: str) -> list[int]:
    """``0-7`` or ``0,2,3``: distinct, at least 0."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, _, hi = part.partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    if not out or len(set(out)) < len(out):
        raise ValueError(f"not a list of distinct indexes: {text!r}")
    return out


def noise_levels(text: str) -> list[str]:
    """``n1=0.01, 0.03``: distinct, finite, at least 0, each in its shortest form."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        try:
            value = Decimal(part.rpartition("=")[2].strip())
        except InvalidOperation as e:
            raise ValueError(f"not a noise level: {part!r}") from e
        if not value.is_finite() or value < 0:
            raise ValueError(f"not a noise level: {part!r}")
        out.append(format(value.normalize(), "f"))
    if not out or len(set(out)) < len(out):
        raise ValueError(f"not a list of distinct levels: {text!r}")
    return out


def wass_label(c: Column) -> Column:
    """025, WASS025 and WASS_025 are one label."""
    return F.concat(F.lit("WASS_"), F.regexp_replace(F.upper(F.trim(c)), r"^WASS_?", ""))


def noise_folder(level: str) -> str:
    """0.01 to 001, 0.1 to 01, 0 to 0."""
    return level.replace(".", "")


def normal_id(c: Column) -> Column:
    """Trimmed text; whole numbers lose their ``.0``, leading zeros stay; NaN and null are empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "null"), "").when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def target_number(c: Column) -> Column:
    """Blank to null; anything that isn't a finite number is an error."""
    t = F.trim(c)
    v = t.try_cast("double")
    return F.when(c.isNull() | (t == ""), F.lit(None).cast("double")).otherwise(must(v.isNotNull() & (F.abs(v) < float("inf")), v, "not a finite number:", c).cast("double"))


def number_text(c: Column) -> Column:
    """Shortest text that reads back as the same number; zero is ``0``."""
    return F.when(c == 0, "0").otherwise(c.cast("string"))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def text_key(c: Column) -> Column:
    """No left side, no white space, ``**`` for ``^``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[^=]*=", ""), r"\s+", ""), r"\^", "**")


def right_side(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^[^=]*=", ""))


def shifted_rows(sheet, label: str, groups: int = 8):
    """The problems with the parameter vectors and variable ranges of one shift label (columns ``paraValue_WASS_K``, ``varRange_WASS_K``)."""
    from fitloom.operators.relational import require_columns

    vector, area = f"paraValue_WASS_{label}", f"varRange_WASS_{label}"
    require_columns(sheet, [vector, area], "the sheet")
    base = problem_rows(sheet.withColumn("paraValue", F.col(vector)).withColumn("varRange", F.col(area)), groups)
    shape = F.forall("var_ranges", lambda g: (F.size(g) == F.size("variables")) & F.forall(g, lambda r: r["lo"] < r["hi"])) & (F.size("var_ranges") == groups) & (F.size("para_values") == groups)
    return base.withColumn("var_ranges", must(shape, F.col("var_ranges"), "shifted ranges don't fit:", F.col("id")))


def problem_rows(sheet, groups: int = 8):
    """A metadata sheet as typed rows, one struct a problem; vectors are checked against the names."""
    from fitloom.operators.relational import require_columns

    require_columns(sheet, ["ID", "GenerationFormula", "Target", "IndependentVars", "ParameterRange", "FixedConstantValues", "paraValue", "varRange", "targetRange"], "the sheet")
    text = lambda n: F.col(n).cast("string") if n in sheet.columns else F.lit(None).cast("string")
    params, variables = ranges(text("ParameterRange")), names(text("IndependentVars"))
    target = json_cell(text("targetRange"))
    return sheet.select(
        normal_id(F.col("ID")).alias("id"), text("ModelName").alias("model_name"), text("OriginalFormula").alias("original_formula"), text("GenerationFormula").alias("generation_formula"), text("simpFormula").alias("simp_formula"),
        F.trim(text("Target")).alias("target"), variables.alias("variables"), params.alias("params"), constants(text("FixedConstantValues")).alias("constants"), constant_order(text("FixedConstantValues")).alias("constant_order"),
        vectors(text("paraValue"), groups, F.size(params), exact=False).alias("para_values"), pairs(literal_list(text("varRange"), "array<array<array<double>>>")).alias("var_ranges"),
        F.transform(target, lambda r: F.struct(F.get(r, 0).alias("lo"), F.get(r, 1).alias("hi"))).alias("target_ranges"),
    )
