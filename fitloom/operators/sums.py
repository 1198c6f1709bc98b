"""Fits of many formulas to datasets of any size, by rounds of sums.

The samples' columns are dealt and written once. A round is one scan of them, whatever the number of formulas: each task evaluates, for the formulas that are not settled, values and
derivatives at the points that they want to know, and puts out one row of sums a formula (counts, squared residuals, normal equations).
The rows of a formula meet in one task, which adds them up and lets the trust region propose the next points. No task holds a
dataset, and what a round sends is as large as the formulas, not as the rows.

Without bounds, rows that agree in all variables are one point from then on, and datasets of up to ``MOST_POINTS`` points need no rounds: a task takes
all steps of some fits over a dataset's points.

The driver carries the fits that are open, ``MOST_FITS`` at a time; more are fitted part by part, each part's results a table of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions import compile as comp
from fitloom.functions.expr import FormulaError
from fitloom.functions.scalars import ERROR_MSE, ERROR_R2, finite
from fitloom.operators import metrics
from fitloom.operators.fitting import FIT_SCHEMA, Prepared, formula_groups, prepare
from fitloom.operators.trust import Damped, State, Sums
from fitloom.sources import sinks

#: Fits of a part, on the average.
MOST_FITS = 20_000
ROUNDS = 400
#: Partitions that the rows of a dataset are dealt to, so that few tasks know it and none has all of a large one.
SPLITS = 64
#: Rows that are evaluated at once.
ROWS = 65536
#: Points of a dataset that a task may hold, and fits that share a copy of them.
MOST_POINTS, SHARE = 10_000, 64
#: What a point has besides its variables and y, the mean target: its rows, and the squares of their targets about the mean.
WEIGHTS = ["rows_", "within_"]


@dataclass
class Work:
    """One formula on one dataset, and the attempts that run side by side."""

    id: str
    grp: int
    formula_id: str
    prepared: Prepared
    states: list[State] = field(default_factory=list)
    n: int = 0
    sst: float = 0.0


class Evaluator:
    """Values and derivatives of a formula, compiled once in a task."""

    def __init__(self, f: Prepared):
        self.f, order = f, [*f.parameters, *f.variables]
        self.value = comp.to_numpy(f.tree, order, f.constants)
        slopes = [comp.derivative(f.tree, p) for p in f.parameters]
        self.slopes = [comp.to_numpy(d, order, f.constants) if d is not None else None for d in slopes]

    def residual(self, p: np.ndarray, data: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        try:
            with np.errstate(all="ignore"):
                return np.broadcast_to(self.value(*p, *data), y.shape) - y
        except OverflowError:  # of a part without variables
            return np.full(y.shape, np.nan)

    def sums(self, p: np.ndarray, data: list[np.ndarray], y: np.ndarray, bounded: bool, slopes: bool = True, weights: list[np.ndarray] | None = None) -> np.ndarray:
        """[rows that aren't finite, squared residuals, a, g]; the first two only without ``slopes``. Within bounds, residuals that aren't finite
        are penalised and such derivatives are 0; points, which have ``weights``, are for fits without bounds."""
        k = len(p)
        r = self.residual(p, data, y)
        good = np.isfinite(r)
        if bounded:
            r = np.where(good, r, 1e6 * np.maximum(1.0, np.abs(y)))
        with np.errstate(all="ignore"):
            n, within = weights or (None, None)
            each = r if n is None else n * r
            head = [len(y) - good.sum() if n is None else n[~good].sum(), r @ each + (0.0 if n is None else within.sum())]
        if not slopes:
            return np.array(head)
        j = np.empty((len(y), k))
        with np.errstate(all="ignore"):
            for i, slope in enumerate(self.slopes):
                column = np.broadcast_to(slope(*p, *data), y.shape) if slope is not None else None
                if column is None or not np.all(np.isfinite(column)):
                    h = 1e-7 * max(1.0, abs(p[i]))
                    q = p.copy()
                    q[i] += h
                    moved = self.residual(q, data, y)
                    column = ((np.where(np.isfinite(moved), moved, r) if bounded else moved) - r) / h
                j[:, i] = column
            if bounded:
                j = np.where(np.isfinite(j), j, 0.0)
            return np.concatenate([head, (j.T @ (j if n is None else n[:, None] * j)).ravel(), j.T @ each])


def spread(y: np.ndarray, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """[count, mean, sum of squares about it], exact for a constant."""
    if not len(y):
        return np.zeros(3)
    n, within = weights or (np.ones(len(y)), np.zeros(1))
    mean = float(y[0] + n @ (y - y[0]) / n.sum())
    return np.array([n.sum(), mean, float(n @ (y - mean) ** 2 + within.sum())])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``spread`` of both together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    gap = b[1] - a[1]
    return np.array([n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n])


def scan(work: bytes, columns: list[str], bounded: bool):
    """Of batches of (id, grp, variables, y): (key, part) for each open work, part being packed sums."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs: dict[tuple[str, int], list[tuple[int, Evaluator, list[list[np.ndarray]]]]] = {}
        for key, problem, grp, prepared, trials in cloudpickle.loads(work):
            jobs.setdefault((problem, grp), []).append((key, Evaluator(prepared), trials))
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                code = rows.column("id").dictionary_encode()
                names = code.dictionary.to_pylist()
                which = code.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 32) + rows.column("grp").to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(which, kind="stable") if np.any(which[1:] < which[:-1]) else slice(None)
                which = which[order]
                cuts = np.flatnonzero(np.r_[True, np.diff(which) != 0, True])
                numbers = {c: rows.column(c).to_numpy(zero_copy_only=False).astype(float, copy=False)[order] for c in columns}
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    w = int(which[lo])
                    for key, evaluator, trials in jobs.get((names[w >> 32], w & 0xFFFFFFFF), ()):
                        found[key] = add(found.get(key), looked({c: v[lo:hi] for c, v in numbers.items()}, evaluator, trials, bounded))
        keys = list(found)
        for begin in range(0, len(keys), 4096):
            some = keys[begin : begin + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([cloudpickle.dumps(found[k]) for k in some], pa.binary())], ["key", "part"])

    return of


def looked(numbers: dict[str, np.ndarray], evaluator: Evaluator, trials: list[list[np.ndarray]], bounded: bool) -> list[np.ndarray]:
    """The spread of the rows that count for a formula, and its sums at the trials of all attempts."""
    good = np.logical_and.reduce([np.isfinite(numbers["y"]), *(np.isfinite(numbers[v]) for v in evaluator.f.own)])
    y, data = numbers["y"][good], [numbers[v][good] for v in evaluator.f.variables]
    weights = [numbers[c][good] for c in WEIGHTS] if WEIGHTS[0] in numbers else None
    return [spread(y, weights), *(evaluator.sums(p, data, y, bounded, not i, weights) for attempt in trials for i, p in enumerate(attempt))]


def add(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
    if a is None:
        return b
    with np.errstate(all="ignore"):
        return [merged(a[0], b[0]), *(x + y for x, y in zip(a[1:], b[1:], strict=True))]


def learn(states: list[State], parts: list[np.ndarray]) -> None:
    """``parts``: as ``looked`` gives them, of all rows."""
    at = 1
    for state in states:
        k, some = len(state.x), []
        for _ in state.trials:
            v = parts[at]
            some.append(Sums(float(v[1]), v[2 : 2 + k * k].reshape(k, k), v[2 + k * k :], int(v[0])) if len(v) > 2 or not k else Sums(float(v[1]), bad=int(v[0])))
            at += 1
        if not state.settled:
            state.learn(some)


def step(work: bytes):
    """Of (key, part), all of a key in one partition: (key, n, sst, states) after the round."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                total[key] = add(total.get(key), cloudpickle.loads(part))
        if not total:
            return
        states = {key: s for key, s in cloudpickle.loads(work) if key in total}
        out = []
        for key, parts in total.items():
            learn(states[key], parts)
            out.append((key, int(parts[0][0]), float(parts[0][2]), cloudpickle.dumps(states[key])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)], ["key", "n", "sst", "states"])

    return of


@dataclass(frozen=True)
class Bound(Prepared):
    """With all variables of the problem, whose rows must be finite."""

    own: tuple[str, ...] = ()


def settle(rows: DataFrame, works: list[Work], columns: list[str], bounded: bool, rounds: int) -> None:
    """Rounds until all attempts of ``works`` are settled."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        open_ = [(i, w) for i, w in enumerate(works) if any(not s.settled for s in w.states)]
        if not open_:
            return
        asked = cloudpickle.dumps([(i, w.id, w.grp, w.prepared, [s.trials for s in w.states]) for i, w in open_])
        known = cloudpickle.dumps([(i, w.states) for i, w in open_])
        sums = rows.mapInArrow(scan(asked, columns, bounded), "key long, part binary")
        new = sums.repartition(min(n, len(open_)), "key").mapInArrow(step(known), "key long, n long, sst double, states binary")
        answered = set()
        for r in new.collect():  # a row a fit that is open
            w = works[r["key"]]
            w.n, w.sst, w.states = r["n"], r["sst"], cloudpickle.loads(r["states"])
            answered.add(r["key"])
        for i, w in open_:
            if i not in answered:  # no rows
                for s in w.states:
                    s.settled, s.trials = True, []


def settle_alone(rows: DataFrame, works: list[Work], variables: list[str], rounds: int) -> None:
    """The same for datasets of few points, in one job: a task holds the points of one dataset at a time, and takes all steps of up to ``SHARE`` fits."""
    if not works:
        return
    shares: dict[tuple[str, int, int], list[tuple[int, Work]]] = {}
    seen: dict[tuple[str, int], int] = {}
    for i, w in enumerate(works):
        at = seen[w.id, w.grp] = seen.get((w.id, w.grp), -1) + 1
        shares.setdefault((w.id, w.grp, at // SHARE), []).append((i, w))
    asked = cloudpickle.dumps({key: [(i, w.prepared, w.states) for i, w in some] for key, some in shares.items()})

    def fits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(variables, kind="stable") if variables else part
        numbers, out = {c: part[c].to_numpy(float) for c in [*variables, "y", *WEIGHTS]}, []
        for key, prepared, states in cloudpickle.loads(asked)[part["id"].iloc[0], int(part["grp"].iloc[0]), int(part["share_"].iloc[0])]:
            evaluator = Evaluator(prepared)
            for _ in range(rounds):
                parts = looked(numbers, evaluator, [s.trials for s in states], False)
                learn(states, parts)
                if all(s.settled for s in states):
                    break
            out.append((key, int(parts[0][0]), float(parts[0][2]), cloudpickle.dumps(states)))
        return pd.DataFrame(out, columns=["key", "n", "sst", "states"])

    spark = rows.sparkSession
    copies = rows.join(F.broadcast(spark.createDataFrame(list(shares), "id string, grp int, share_ int")), ["id", "grp"])  # up to MOST_FITS rows
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = copies.repartition(n, "id", "grp", "share_").groupBy("id", "grp", "share_").applyInPandas(fits, "key long, n long, sst double, states binary")
    for r in found.collect():  # a row a fit
        w = works[r["key"]]
        w.n, w.sst, w.states = r["n"], r["sst"], cloudpickle.loads(r["states"])


def points(rows: DataFrame, variables: list[str]) -> DataFrame:
    """(id, grp, variables, y, rows_, within_): rows of (id, grp, variables, y) that agree in all variables as one, whose y is their mean.

    No formula tells them apart, so its squared residuals are rows_ * (f - y)^2 + within_, summed over points. Zeros of both signs stay apart, as
    quotients do; rows whose target isn't finite are left out. Points are added up before the shuffle, then dealt and written.
    """
    y, keys = F.col("y"), ["id", "grp", *(f"`{v}`" for v in variables)]
    signs = {f"sign{i}_": F.when(F.col(f"`{v}`") == 0, F.col(f"`{v}`").cast("string")) for i, v in enumerate(variables)}
    found = rows.filter(finite(y)).groupBy(*keys, *(c.alias(n) for n, c in signs.items())).agg(F.when(F.min(y) == F.max(y), F.min(y)).otherwise(F.avg(y)).alias("y"), F.count("*").cast("double").alias(WEIGHTS[0]), metrics.sst(y).alias(WEIGHTS[1]))
    whole = found.select("id", "grp", *(F.when(F.col(n) == "-0.0", F.lit(-0.0)).otherwise(F.col(f"`{v}`")).alias(v) for v, n in zip(variables, signs)), "y", *WEIGHTS)
    at = F.pmod(F.xxhash64("id", *keys[2:]), F.lit(SPLITS))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sinks.between(whole.repartition(n, "id", "grp", at).sortWithinPartitions("id", "grp"))


def starts(f: Prepared, attempts: range, seed: int, key: str, bounded: bool, retries: int) -> list[State]:
    """The exact initial values are attempt 0; the others lie around them, by a stream of the seed and the key alone."""
    m, start = len(f.parameters), np.array(f.initial, float)
    lower, upper = (np.array(f.lower, float), np.array(f.upper, float)) if bounded else (np.full(m, -np.inf), np.full(m, np.inf))
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{key}".encode()).digest()[:8], "little") % (2**32 - 1))
    points = [start]
    for _ in range(retries):
        points.append(np.clip(start + rng.normal(0, 1, m) * 0.15 * (np.abs(start) + 1), lower, upper) if bounded else start + rng.normal(0, 0.5, m) * np.maximum(np.abs(start), 1))
    return [(State if bounded else Damped).begin(points[i], lower, upper) for i in attempts]


def good(s: State, w: Work) -> bool:
    return w.n > 0 and s.sums is not None and s.sums.bad == 0 and np.isfinite(s.sums.sse)


def scored(w: Work, sse: float) -> tuple[float, float, float]:
    """(mse, nmse, r2) with the rules for a constant target."""
    if w.sst == 0:
        return sse / w.n, 0.0 if sse == 0 else float("nan"), 1.0 if sse <= 1e-24 else ERROR_R2
    return sse / w.n, sse / w.sst, 1 - sse / w.sst


def fit_sums(samples: DataFrame, formulas: DataFrame, variables: list[str], y: str = "y", constants: dict[str, float] | None = None, ranges: dict[str, tuple[float, float]] | None = None, bounded: bool = False, protected: bool = False, retries: int = 2, seed: int = 0, strict: bool = True, rounds: int = ROUNDS, kept: bool = False) -> DataFrame:
    """Every formula of an id on every group of that id, as ``fitting.fit_groups`` gives it, for groups of any size.

    ``samples``: id, grp, the variables, y. ``formulas``: id, formula_id, formula, para_list, orgpara_list, and, where problems differ in them,
    ``variables`` (array), ``constants`` (map) and ``ranges`` (array of name, lo, hi), which stand before the arguments. Rows of which
    the target or one of the problem's own variables isn't finite are left out. A formula that can't be prepared fails in its own row. Unbounded,
    other starts are tried only if the exact one fails; within bounds all are, and the lowest sum of squares that is finite counts. Each round
    reads the samples' columns again, which are dealt and written once for that, as points where there are no bounds, or, with ``kept``, as they are.
    """
    spark = samples.sparkSession
    there = lambda c, value, kind: value if c in formulas.columns else F.lit(None).cast(kind)
    listed = formulas.select(
        "id", "formula_id", "formula", "para_list", "orgpara_list", there("variables", F.col("variables"), "array<string>").alias("own"), there("constants", F.col("constants"), "map<string,double>").alias("constants"),
        there("ranges", F.expr("transform(ranges, x -> struct(x.name as name, cast(x.lo as double) as lo, cast(x.hi as double) as hi))") if "ranges" in formulas.columns else None, "array<struct<name:string,lo:double,hi:double>>").alias("ranges"),
    )
    rows = samples.select(F.col("id").cast("string").alias("id"), F.col("grp").cast("int").alias("grp"), *(F.col(f"`{v}`").cast("double").alias(v) for v in variables), F.col(y).cast("double").alias("y"))
    columns, large = [*variables, "y"], None
    if not kept and not bounded:
        rows, columns = points(rows, variables), columns + WEIGHTS
        large = {(r["id"], r["grp"]) for r in rows.groupBy("id", "grp").count().filter(F.col("count") > MOST_POINTS).collect()}  # a dataset each
    elif not kept:
        at = F.pmod(F.xxhash64("y", *variables), F.lit(SPLITS))
        rows = sinks.between(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "grp", at).sortWithinPartitions("id", "grp"))
    work = sinks.between(formula_groups(listed, samples.select("id", "grp"), ["id"], "grp"))
    parts = -(-work.count() // MOST_FITS)
    out = None
    for part in range(parts):
        mine = work if parts == 1 else work.filter(F.pmod(F.xxhash64("id", "grp", "formula_id"), F.lit(parts)) == part)
        found = fit_part(rows, mine.collect(), variables, columns, large, constants, ranges, bounded, protected, retries, seed, strict, rounds)
        table = sinks.between(spark.createDataFrame(found, FIT_SCHEMA))
        out = table if out is None else out.unionByName(table)
    return out if out is not None else spark.createDataFrame([], FIT_SCHEMA)


def fit_part(rows: DataFrame, listed: list, variables: list[str], columns: list[str], large: set[tuple[str, int]] | None, constants, ranges, bounded: bool, protected: bool, retries: int, seed: int, strict: bool, rounds: int) -> list[tuple]:
    """The results of ``listed`` formulas on datasets, as rows of ``FIT_SCHEMA``. ``rows`` are points if ``large``, the datasets of many, is given."""
    works, results = [], []
    for r in listed:
        own = list(variables if r["own"] is None else r["own"])
        fixed = constants if r["constants"] is None else dict(r["constants"])
        limits = ranges if r["ranges"] is None else {x["name"]: (x["lo"], x["hi"]) for x in r["ranges"]}
        try:
            f = prepare(r["formula"], own, list(r["para_list"] or []), list(r["orgpara_list"] or []), fixed, limits, protected, strict)
        except FormulaError as e:
            results.append((r["id"], r["formula_id"], r["grp"], False, ERROR_MSE, ERROR_MSE, ERROR_R2, [], 0, False, str(e)))
            continue
        works.append(Work(r["id"], r["grp"], r["formula_id"], Bound(*(getattr(f, name) for name in Prepared.__dataclass_fields__), own=tuple(own))))
    name = lambda w: f"{w.id}|{w.grp}|{w.formula_id}"

    def settled(some: list[Work]) -> None:
        by_rounds = [w for w in some if large is None or (w.id, w.grp) in large]
        settle(rows, by_rounds, columns, bounded, rounds)
        if large is not None:
            settle_alone(rows, [w for w in some if (w.id, w.grp) not in large], variables, rounds)

    for w in works:
        w.states = starts(w.prepared, range(1 + retries) if bounded else range(1), seed, name(w), bounded, retries)
    settled(works)
    again = [w for w in works if not bounded and retries and w.n and w.prepared.parameters and not good(w.states[0], w)]
    for w in again:
        w.states = starts(w.prepared, range(1, 1 + retries), seed, name(w), bounded, retries)
    settled(again)
    later = {id(w) for w in again}
    for w in works:
        fine = [(s.sums.sse, i) for i, s in enumerate(w.states) if good(s, w)]
        tried = 1 + retries if id(w) in later else 1
        if not fine:
            why = "no rows" if not w.n else "no start gave a finite fit" if w.prepared.parameters else "not finite"
            results.append((w.id, w.formula_id, w.grp, False, ERROR_MSE, ERROR_MSE, ERROR_R2, [float(v) for v in w.prepared.initial], tried, tried > 1, why))
            continue
        sse, i = min(fine)
        attempt = i + 1 + (1 if id(w) in later else 0)
        results.append((w.id, w.formula_id, w.grp, True, *scored(w, sse), [float(v) for v in w.states[i].x], attempt, attempt > 1, ""))
    return results
