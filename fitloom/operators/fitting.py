"""Least-squares fits of formulas to groups of rows.

Formulas that are linear in their parameters are fitted with one pass of sums (plain aggregates); one nonlinear formula on groups of
any size by rounds of such passes (``fit_by_sums``), many of them by ``sums.fit_sums``, which ``fit_groups`` calls, as the stages do. ``fit_one``
fits rows that are in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import compile as comp
from fitloom.functions.expr import CONSTANTS, FormulaError, Node, names, natural_key, parse, protect_powers, show, substitute
from fitloom.functions.scalars import ERROR_MSE, ERROR_R2
from fitloom.operators import metrics, trust
from fitloom.sources import sinks


@dataclass(frozen=True)
class Prepared:
    """A formula with its names resolved."""

    tree: Node
    variables: tuple[str, ...]
    parameters: tuple[str, ...]
    initial: tuple[float, ...]
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    constants: dict[str, float]


def prepare(text: str, variables: list[str], parameters: list[str], initial: list[float], constants: dict[str, float] | None = None, ranges: dict[str, tuple[float, float]] | None = None, protected: bool = False, strict: bool = True, dialect: str | None = None) -> Prepared:
    """Resolve names. With ``strict=False`` an unknown name that has a range becomes a parameter: it starts at the middle, within the range."""
    if len(parameters) != len(initial):
        raise FormulaError(f"{len(parameters)} parameters but {len(initial)} initial values")
    tree = parse(text, dialect)
    found, constants, ranges = names(tree), constants or {}, ranges or {}
    if unused := [p for p in parameters if p not in found]:
        raise FormulaError(f"parameters that don't occur: {', '.join(unused)}")
    parameters, initial = list(parameters), [float(x) for x in initial]
    bounds = [(-np.inf, np.inf)] * len(parameters)
    for name in sorted(found - set(variables) - set(parameters) - set(constants) - set(CONSTANTS), key=natural_key):
        if strict or name not in ranges:
            raise FormulaError(f"unknown name {name}")
        lo, hi = ranges[name]
        parameters.append(name)
        initial.append((lo + hi) / 2)
        bounds.append((lo, hi))
    return Prepared(protect_powers(tree) if protected else tree, tuple(v for v in variables if v in found), tuple(parameters), tuple(initial), tuple(b[0] for b in bounds), tuple(b[1] for b in bounds), constants)


@dataclass
class Fit:
    ok: bool
    params: np.ndarray
    mse: float
    nmse: float
    r2: float
    attempts: int = 1
    retry_used: bool = False
    error: str = ""


def scores(y: np.ndarray, fitted: np.ndarray, counts: np.ndarray | None = None, within: float = 0.0) -> tuple[float, float, float]:
    """(mse, nmse, r2) with the rules for a constant target."""
    n, rows = (1.0, len(y)) if counts is None else (counts, float(counts.sum()))
    sse = float(np.sum(n * (y - fitted) ** 2)) + within
    sst = float(np.sum(n * (y - (y.mean() if counts is None else y[0] + counts @ (y - y[0]) / rows)) ** 2)) + within
    if sst == 0:
        return sse / rows, 0.0 if sse == 0 else float("nan"), 1.0 if sse <= 1e-24 else ERROR_R2
    return sse / rows, sse / sst, 1 - sse / sst


def marquardt(residual: Callable, jacobian: Callable, start: np.ndarray, most: int = 200, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton with scaled columns. Returns the best finite point that was visited and its cost."""
    p = start
    r = residual(p)
    with np.errstate(over="ignore", invalid="ignore"):
        cost = float(r @ r)
    best, best_cost = p, cost if np.isfinite(cost) else np.inf
    damping, quiet = 1e-3, 0
    for _ in range(most):
        j = jacobian(p, r)
        if not np.all(np.isfinite(j)):
            break
        scale = np.sqrt((j * j).sum(axis=0))
        scale[scale == 0] = 1.0
        js = j / scale
        a, g = js.T @ js, js.T @ r
        moved = False
        while damping < 1e14:
            try:
                step = np.linalg.solve(a + damping * np.eye(len(p)), -g) / scale
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            q = p + step
            s = residual(q)
            with np.errstate(over="ignore", invalid="ignore"):
                new = float(s @ s)
            if np.isfinite(new) and new < best_cost:
                moved = True
                break
            damping *= 4
        if not moved:
            break
        gain = best_cost - new
        p, r = q, s
        best, best_cost = q, new
        damping = max(damping / 6, 1e-15)
        quiet = quiet + 1 if gain <= tolerance * best_cost else 0
        if quiet >= 2 or best_cost == 0:
            break
    return best, best_cost


def fit_one(f: Prepared, x: dict[str, np.ndarray], y: np.ndarray, retries: int = 2, seed: int = 0, key: str = "", bounded: bool = False, counts: np.ndarray | None = None, within: float = 0.0) -> Fit:
    """Fit from the exact initial values. Unbounded: jittered starts only if that fails, the lowest MSE wins. Bounded, by the reflective trust
    region: all starts are tried, residuals that aren't finite are penalised, and the best finite point counts. With ``counts``, without bounds, each row stands for as many, whose targets have the mean ``y`` and
    whose squares about their means are ``within`` in all."""
    m = len(f.parameters)
    order = [*f.parameters, *f.variables]
    data = [np.asarray(x[v], float) for v in f.variables]
    value = comp.to_numpy(f.tree, order, f.constants)
    shape = np.shape(y)
    predict = lambda p: np.broadcast_to(value(*p, *data), shape)
    fail = lambda why, n=1: Fit(False, np.array(f.initial), ERROR_MSE, ERROR_MSE, ERROR_R2, n, n > 1, why)
    if not len(y):
        return fail("no rows")
    if m == 0:
        fitted = predict(())
        return Fit(True, np.array([]), *scores(y, fitted, counts, within)) if np.all(np.isfinite(fitted)) else fail("not finite")
    slopes = [comp.derivative(f.tree, p) for p in f.parameters]
    exact = [comp.to_numpy(d, order, f.constants) if d is not None else None for d in slopes]
    penalty = 1e6 * np.maximum(1.0, np.abs(y))
    root = None if counts is None else np.sqrt(counts)

    def residual(p: np.ndarray) -> np.ndarray:
        r = predict(p) - y
        return np.where(np.isfinite(r), r, penalty) if bounded else r if root is None else np.append(r * root, np.sqrt(within))

    def jacobian(p: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty((len(r), m))
        for k in range(m):
            column = np.broadcast_to(exact[k](*p, *data), shape) if exact[k] is not None else None
            if column is None or not np.all(np.isfinite(column)):
                h = 1e-7 * max(1.0, abs(p[k]))
                q = p.copy()
                q[k] += h
                column = (residual(q) - r) / h
            elif root is not None:
                column = np.append(column * root, 0.0)
            out[:, k] = column
        return np.where(np.isfinite(out), out, 0.0) if bounded else out

    def sums(p: np.ndarray) -> trust.Sums:
        r = residual(p)
        j = jacobian(p, r)
        with np.errstate(all="ignore"):
            return trust.Sums(float(r @ r), j.T @ j, j.T @ r)

    start = np.array(f.initial, float)
    lower, upper = (np.array(f.lower), np.array(f.upper)) if bounded else (np.full(m, -np.inf), np.full(m, np.inf))
    digest = hashlib.sha256(f"{seed}|{key}".encode()).digest()
    rng = np.random.default_rng(int.from_bytes(digest[:8], "little") % (2**32 - 1))
    best: Fit | None = None
    for attempt in range(1 + retries):
        if attempt == 0:
            p = start
        elif bounded:
            p = np.clip(start + rng.normal(0, 1, m) * 0.15 * (np.abs(start) + 1), lower, upper)
        else:
            p = start + rng.normal(0, 0.5, m) * np.maximum(np.abs(start), 1)
        point, cost = trust.minimum(sums, p, lower, upper) if bounded else marquardt(residual, jacobian, p)
        fitted = predict(point)
        if np.isfinite(cost) and np.all(np.isfinite(fitted)):
            found = Fit(True, point, *scores(y, fitted, counts, within), attempt + 1, attempt > 0)
            if best is None or found.mse < best.mse:
                best = found
            if not bounded:  # a poor fit is no failure
                break
    return best or fail("no start gave a finite fit", 1 + retries)


FIT_SCHEMA = "id string, formula_id string, grp int, ok boolean, mse double, nmse double, r2 double, params array<double>, attempts int, retry_used boolean, error string"


#: Datasets and formulas of one block of the product, about; a task holds the rows of some blocks of two at a time.
BLOCK_GROUPS, BLOCK_FORMULAS = 512, 1024
#: Formulas that take turns in the rows of a block: as many come again and again, so a column of them is written as a short, repeated run.
TURN = 128


def blocks(rows: DataFrame, keys: list[str], size: int, block: str, values: str) -> DataFrame:
    """(keys, ``block``, ``values``): the other columns of ``rows`` as arrays of about ``size``, dealt by their hash, so a task that runs again deals alike."""
    rest = [f.name for f in rows.schema.fields if f.name not in keys]
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    column = lambda c: F.col(f"`{c}`")
    shares = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("shares_"))
    dealt = rows.join(shares, keys).select(*keys, F.pmod(F.xxhash64(*map(column, hashed)), "shares_").alias(block), F.struct(F.lit(0).alias("there_"), *map(column, rest)).alias(values))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys, block).groupBy(*keys, block).agg(F.collect_list(values).alias(values))


def formula_groups(formulas: DataFrame, groups: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Every formula of a problem with every dataset of that problem.

    Blocks meet, not rows: a problem with many of both is dealt to all tasks, as ranges of pairs of blocks, and their rows come about
    last. Neighbouring rows are of few datasets and formulas, so that the product, which has the square of the rows, takes little room in columns.
    Formulas that are alike stand in one block.
    """
    n = int(formulas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks(groups.select(*keys, group).distinct(), keys, BLOCK_GROUPS, "group_block_", "groups_")
    right = blocks(formulas, keys, BLOCK_FORMULAS, "formula_block_", "formulas_")
    pairs = left.join(right, keys).repartitionByRange(n, *keys, "group_block_", "formula_block_")
    turns = F.transform(F.sequence(F.lit(1), F.size("formulas_"), F.lit(TURN)), lambda first: F.slice("formulas_", first, TURN))
    rows = pairs.select(*keys, "groups_", F.explode(turns).alias("turn_")).select(*keys, F.explode("groups_").alias("group_"), "turn_").select(*keys, "group_", F.explode("turn_").alias("formula_"))
    part = lambda side, c: F.col(side).getField(c).alias(c)
    return rows.select(*keys, part("group_", group), *(part("formula_", c) for c in formulas.columns if c not in keys))


def fit_groups(samples: DataFrame, formulas: DataFrame, variables: list[str], y: str = "y", constants: dict[str, float] | None = None, ranges: dict[str, tuple[float, float]] | None = None, bounded: bool = False, protected: bool = False, retries: int = 2, seed: int = 0, order: str | None = None, strict: bool = True) -> DataFrame:
    """Every formula of an id on every group of that id: ``sums.fit_sums``, whose tasks hold a batch of rows and sums, never a group.

    ``order`` says in which order a group's rows stood when they met in one task; sums don't depend on it but for their last bits.
    """
    from fitloom.operators.sums import fit_sums

    return fit_sums(samples, formulas, variables, y, constants, ranges, bounded, protected, retries, seed, strict)


def linear_fit(rows: DataFrame, keys: list[str], text: str, parameters: list[str], variables: dict[str, Column], y: str) -> DataFrame:
    """(keys, parameters, n): closed form for formulas linear in up to three parameters, from one pass of sums of products.

    The normal equations are solved by Cramer's rule in columns; a group without a unique solution has null parameters.
    """
    parts = comp.linear_in(parse(text), parameters)
    if parts is None or not 1 <= len(parameters) <= 3:
        raise FormulaError("not linear in one to three parameters")
    base, *factors = [comp.to_column(p, variables) for p in parts]
    target, k = F.col(y) - base, len(factors)
    sums = {f"a{i}{j}": F.sum(factors[i] * factors[j]) for i in range(k) for j in range(i, k)} | {f"b{i}": F.sum(factors[i] * target) for i in range(k)}
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(c.cast("double").alias(n) for n, c in sums.items()))
    a = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return m[0][0] * det([r[1:] for r in m[1:]]) - m[0][1] * det([[r[0], r[2]] for r in m[1:]]) + m[0][2] * det([r[:2] for r in m[1:]])

    matrix = [[a(i, j) for j in range(k)] for i in range(k)]
    whole = det(matrix)
    solve = lambda c: det([[F.col(f"b{i}") if j == c else matrix[i][j] for j in range(k)] for i in range(k)]) / F.when(whole != 0, whole)
    return agg.select(*keys, "n", *(solve(c).alias(p) for c, p in enumerate(parameters)))


def fit_by_sums(rows: DataFrame, keys: list[str], text: str, initial: dict[str, float], variables: dict[str, Column], y: str, rounds: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """(keys, parameters, n, mse, r2, ok): a nonlinear fit of groups of any size by damped Gauss-Newton steps.

    Each round is one aggregate: the derivatives are columns, and a group's normal equations are sums of their products, added up
    before the shuffle. What goes through Python is one row a group, where the step is solved; rows stay in the JVM. A step that
    doesn't lower the sum of squares is taken back and damped more. The table of groups is written between rounds.
    """
    names_, k = list(initial), len(initial)
    tree = parse(text)
    slopes = [comp.derivative(tree, p) for p in names_]
    if any(d is None for d in slopes) or not k:
        raise FormulaError("a formula with derivatives by at least one parameter is needed")
    at = {p: F.col(f"try_{p}") for p in names_}
    r = comp.to_column(tree, variables, at) - F.col(y)
    j = [comp.to_column(d, variables, at) for d in slopes]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name in keys]
    numbers = [*names_, *(f"try_{p}" for p in names_), "sse", "damping"]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kinds), *(f"`{n}` double" for n in numbers), "n long", "sst double", "settled boolean"])
    state = rows.select(*keys).distinct().select(*keys, *(F.lit(initial[p]).alias(p) for p in names_), *(F.lit(initial[p]).alias(f"try_{p}") for p in names_), F.lit(float("inf")).alias("sse"), F.lit(1e-3).alias("damping"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sst"), F.lit(False).alias("settled"))

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, row in enumerate(part.to_dict("records")):
                new = row["new_sse"]
                if np.isfinite(new) and new <= row["sse"]:
                    gain = row["sse"] - new
                    best = [row[f"try_{p}"] for p in names_]
                    a = np.empty((k, k))
                    for x, z in pairs:
                        a[x, z] = a[z, x] = row[f"a{x}_{z}"]
                    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
                    damping = max(row["damping"] / 6, 1e-12)
                    stop = bool(gain <= tolerance * new) or new == 0
                    g = np.array([row[f"b{x}"] for x in range(k)])
                    delta = np.linalg.lstsq(a / np.outer(scale, scale) + damping * np.eye(k), -g / scale, rcond=None)[0] / scale if np.all(np.isfinite(a)) and np.all(np.isfinite(g)) else np.zeros(k)
                    changes = {"sse": new, "settled": stop or not delta.any()} | dict(zip(names_, best)) | {f"try_{p}": b + d for p, b, d in zip(names_, best, delta)}
                else:  # back, and half the way
                    damping = row["damping"] * 10
                    changes = {"settled": damping > 1e12} | {f"try_{p}": (row[p] + row[f"try_{p}"]) / 2 for p in names_}
                for name, value in ({"damping": damping, "n": row["new_n"], "sst": row["new_sst"]} | changes).items():
                    part.at[part.index[i], name] = value
            yield part[[n for n, _ in kinds] + numbers + ["n", "sst", "settled"]]

    for _ in range(rounds):
        state = sinks.between(state)
        open_ = state.filter("not settled")
        if not open_.take(1):
            break
        sums = rows.join(open_, keys).groupBy(*keys).agg(F.sum(r * r).alias("new_sse"), F.count("*").alias("new_n"), metrics.sst(F.col(y)).alias("new_sst"), *(F.sum(j[a] * j[b]).alias(f"a{a}_{b}") for a, b in pairs), *(F.sum(j[a] * r).alias(f"b{a}") for a in range(k)))
        state = open_.join(sums, keys).mapInPandas(step, schema).unionByName(state.filter("settled"))
    done = F.col("sse") < float("inf")
    return state.select(*keys, *(F.when(done, F.col(p)).alias(p) for p in names_), "n", F.when(done, F.col("sse") / F.col("n")).alias("mse"), F.when(done, metrics.r2_of(F.col("sse"), F.col("sst"))).alias("r2"), done.alias("ok"))


def score_with(rows: DataFrame, text: str, variables: dict[str, Column], parameters: dict[str, Column | float] | None = None, constants: dict[str, float] | None = None, protected: bool = False) -> DataFrame:
    """``rows`` with ``fitted``; a formula without free parameters needs no more than this."""
    tree = parse(text)
    return rows.withColumn("fitted", comp.to_column(protect_powers(tree) if protected else tree, variables, parameters, constants))


def baseline(samples: DataFrame, specs: DataFrame, variables: list[str], fit: Callable[..., DataFrame] = fit_groups, **options) -> DataFrame:
    """The bounded fit of each problem's true formula, its parameters within their ranges: what a perfect search could reach. ``fit`` is
    ``fit_groups`` or ``sums.fit_sums``."""
    formulas = specs.select("id", F.lit("true").alias("formula_id"), F.col("generation_formula").alias("formula"), F.array().cast("array<string>").alias("para_list"), F.array().cast("array<double>").alias("orgpara_list"), "variables", "constants", F.col("params").alias("ranges"))
    return fit(samples, formulas, variables, bounded=True, protected=True, strict=False, **options)


def with_values(text: str, values: dict[str, float]) -> str:
    return show(substitute(parse(text), values))

