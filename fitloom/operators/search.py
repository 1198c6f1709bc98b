"""Formula search: islands of small populations, each evolved in one task, joined to one Pareto front by plain aggregates.

A formula's loss is its mean squared error, its complexity the weighted count of its nodes. Datasets of a problem are searched one
after the other, the front of one being the start of the next; problems and islands run side by side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.functions.compile import to_numpy
from fitloom.functions.expr import FormulaError, Name, Node, Num, Op, complexity, generalise, parse, show, substitute, walk
from fitloom.functions.scalars import finite
from fitloom.operators import metrics, sums
from fitloom.operators.fitting import Prepared, fit_one
from fitloom.operators.ranking import lowest_loss, scored_front
from fitloom.sources import sinks

# Operators of the search, and how often which function may stand inside which.
BINARY = ("+", "-", "*", "/", "**")
UNARY = ("cos", "sin", "exp", "sqrt", "log", "tanh", "acos", "atan", "atanh")
_PERIODIC = {"sin": 0, "cos": 0, "acos": 0, "atanh": 0, "tanh": 0}
NESTING = {
    "sin": _PERIODIC, "cos": _PERIODIC, "acos": _PERIODIC, "tanh": _PERIODIC, "atanh": _PERIODIC, "exp": {"exp": 0, "log": 0}, "log": {"log": 0, "exp": 0}, "sqrt": {"sqrt": 1},
}


@dataclass(frozen=True)
class Settings:
    iterations: int = 10
    islands: int = 20
    population: int = 40
    max_size: int = 50
    parsimony: float = 0.001
    exponent_size: int = 1
    seed: int = 0


def depth_of(node: Node, kind: str) -> int:
    """How deep ``kind`` is nested in the tree."""
    if not isinstance(node, Op):
        return 0
    return (node.kind == kind) + max((depth_of(a, kind) for a in node.args), default=0)


def allowed(node: Node, settings: Settings) -> bool:
    if complexity(node) > settings.max_size:
        return False
    for n in walk(node):
        if isinstance(n, Op):
            if n.kind == "**" and complexity(n.args[1]) > settings.exponent_size:
                return False
            for inner, most in NESTING.get(n.kind, {}).items():
                if max(depth_of(a, inner) for a in n.args) > most:
                    return False
    return True


class Island:
    """One population on one dataset, of rows or of points that stand for ``counts`` rows, whose squares about their means are ``within`` in all."""

    def __init__(self, variables: list[str], x: np.ndarray | None, y: np.ndarray | None, settings: Settings, rng: np.random.Generator, spread: float | None = None, counts: np.ndarray | None = None, within: float = 0.0):
        self.variables, self.x, self.y, self.settings, self.rng, self.counts, self.within = variables, x, y, settings, rng, counts, within
        self.spread = (float(np.var(y)) if spread is None else spread) or 1.0
        self.front: dict[int, tuple[float, Node]] = {}

    def leaf(self) -> Node:
        if self.rng.random() < 0.6:
            return Name(self.variables[self.rng.integers(len(self.variables))])
        return Num(float(np.round(self.rng.normal(0, 2), 3)))

    def grow(self, depth: int) -> Node:
        if depth == 0 or self.rng.random() < 0.2:
            return self.leaf()
        if self.rng.random() < 0.3:
            return Op(UNARY[self.rng.integers(len(UNARY))], (self.grow(depth - 1),))
        kind = BINARY[self.rng.integers(len(BINARY))]
        return Op(kind, (self.grow(depth - 1), self.leaf() if kind == "**" else self.grow(depth - 1)))

    def loss(self, node: Node) -> float:
        try:
            out = to_numpy(node, self.variables)(*self.x)
        except (FormulaError, OverflowError):
            return math.inf
        if not np.all(np.isfinite(out)):
            return math.inf
        with np.errstate(all="ignore"):
            squares = (out - self.y) ** 2
            value = float(np.mean(squares) if self.counts is None else (self.counts @ squares + self.within) / self.counts.sum())
        return value if math.isfinite(value) else math.inf

    def keep(self, node: Node, loss: float) -> None:
        size = complexity(node)
        if math.isfinite(loss) and (size not in self.front or loss < self.front[size][0]):
            self.front[size] = (loss, node)

    def replace_at(self, node: Node, at: int, by: Node) -> Node:
        count = -1

        def go(n: Node) -> Node:
            nonlocal count
            count += 1
            if count == at:
                count += sum(1 for _ in walk(n)) - 1
                return by
            return Op(n.kind, tuple(go(a) for a in n.args)) if isinstance(n, Op) else n

        return go(node)

    def vary(self, node: Node, other: Node) -> Node:
        nodes = list(walk(node))
        at = int(self.rng.integers(len(nodes)))
        pick, r = nodes[at], self.rng.random()
        if r < 0.25 and isinstance(pick, Num):
            return self.replace_at(node, at, Num(pick.value * float(np.exp(self.rng.normal(0, 0.3)))))
        if r < 0.4:
            return self.replace_at(node, at, self.grow(2))
        if r < 0.55 and isinstance(pick, Op) and len(pick.args) == 2:
            return self.replace_at(node, at, Op(BINARY[self.rng.integers(4)], pick.args))
        if r < 0.7:
            return self.replace_at(node, at, Op(BINARY[self.rng.integers(4)], (pick, self.leaf())))
        if r < 0.8:
            return self.replace_at(node, at, self.leaf())
        theirs = list(walk(other))
        return self.replace_at(node, at, theirs[self.rng.integers(len(theirs))])

    def prepared(self, node: Node) -> Prepared | None:
        """The structure of ``node`` with its numbers as parameters; None without any."""
        tree, parameters, initial = generalise(node)
        used = tuple(v for v in self.variables if any(isinstance(n, Name) and n.id == v for n in walk(tree)))
        m = len(parameters)
        return Prepared(tree, used, tuple(parameters), tuple(initial), (-np.inf,) * m, (np.inf,) * m, {}) if m else None

    def tuned(self, node: Node) -> Node:
        """The same structure with its numbers fitted."""
        prepared = self.prepared(node)
        if prepared is None:
            return node
        found = fit_one(prepared, dict(zip(self.variables, self.x)), self.y, retries=0, counts=self.counts, within=self.within)
        return substitute(prepared.tree, dict(zip(prepared.parameters, (float(v) for v in found.params)))) if found.ok else node

    def fitness(self, entry: tuple[float, Node]) -> float:
        return entry[0] / self.spread + self.settings.parsimony * complexity(entry[1])

    def steps(self, seeds: list[Node]) -> Iterator[list[tuple[str, Node]]]:
        """The evolution. It yields what it wants to know, ``loss`` or ``tune`` of formulas, and is sent the answers in order.

        Children are asked for together until one would be bred from, or take the place of, one whose loss isn't known yet; each comes out as if they
        were judged one by one.
        """
        s = self.settings
        people = [n for n in seeds if allowed(n, s)][: s.population]
        while len(people) < s.population:
            n = self.grow(3)
            if allowed(n, s):
                people.append(n)
        scored = list(zip((yield [("loss", n) for n in people]), people))
        for loss, n in scored:
            self.keep(n, loss)
        for _ in range(s.iterations):
            waiting: dict[int, tuple[Node, tuple[float, Node]]] = {}
            for _ in range(4 * s.population):
                picks = [int(i) for i in self.rng.integers(0, len(scored), 6)]
                if any(i in waiting for i in picks):
                    yield from self.judged(scored, waiting)
                pool = [scored[i] for i in picks]
                mother, father = sorted(pool, key=self.fitness)[:2]
                child = self.vary(mother[1], father[1])
                if not allowed(child, s):
                    continue
                worst = pool[max(range(6), key=lambda i: self.fitness(pool[i]))]
                if any(n == worst[1] for n, _ in waiting.values()) or scored.index(worst) in waiting:
                    yield from self.judged(scored, waiting)
                waiting[scored.index(worst)] = (child, worst)
            yield from self.judged(scored, waiting)
            some = sorted(self.front.items(), key=lambda kv: kv[1][0])[:6]
            better = yield [("tune", n) for _, (_, n) in some]
            losses = yield [("loss", n) for n in better]
            for (size, (loss, _)), n, new in zip(some, better, losses):
                self.keep(n, new)
                if complexity(n) == size and self.front[size][0] < loss:
                    scored[int(self.rng.integers(len(scored)))] = self.front[size]

    def judged(self, scored: list[tuple[float, Node]], waiting: dict[int, tuple[Node, tuple[float, Node]]]) -> Iterator[list[tuple[str, Node]]]:
        losses = (yield [("loss", n) for n, _ in waiting.values()]) if waiting else []
        for (at, (child, worst)), loss in zip(waiting.items(), losses):
            self.keep(child, loss)
            if self.fitness((loss, child)) < self.fitness(worst):
                scored[at] = (loss, child)
        waiting.clear()

    def run(self, seeds: list[Node]) -> None:
        """The evolution over rows that are in memory."""
        steps, answers = self.steps(seeds), None
        try:
            while True:
                answers = [self.loss(n) if kind == "loss" else self.tuned(n) for kind, n in steps.send(answers)]
        except StopIteration:
            pass


#: Rows or points of a dataset that an island may hold.
MOST_ROWS = 100_000


def stream(settings: Settings, problem: str, dataset: int, island: int) -> np.random.Generator:
    digest = hashlib.sha256(f"{settings.seed}|{problem}|{dataset}|{island}".encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little"))


FRONT = "id string, dataset int, island int, complexity int, loss double, equation string"


def search_dataset(samples: DataFrame, variables: list[str], dataset: int, settings: Settings, seeds: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, dataset, island, complexity, loss, equation) of all islands. ``samples``: id, the variables, y, for one dataset.

    Datasets of up to ``MOST_ROWS`` rows are read whole by each island, in a task of its own. Of larger ones, rows that agree in all variables become
    one point (``sums.points``); up to ``MOST_ROWS`` points are read by each island, and more are evolved by rounds of scans, in which no task holds
    a dataset. All give the same formulas but for the last bits of their sums.
    """
    start = {k: list(v) for k, v in (seeds or {}).items()}
    target = F.when(finite(F.col("y")), F.col("y"))
    sizes = samples.groupBy("id").agg(F.count("*").alias("n"), (metrics.sst(target) / F.nullif(F.count(target), F.lit(0))).alias("v"))
    is_large = (F.col("n") > MOST_ROWS) & F.col("id").isNotNull()
    known = sizes.agg(F.collect_list(F.when(is_large, F.struct("id", "v"))).alias("large"), F.count_if(~is_large).alias("small")).first()  # a problem each
    large = {r["id"]: r["v"] for r in known["large"]}
    if not large:
        return search_small(samples.select("id", *variables, "y"), variables, dataset, settings, start)
    is_large = F.coalesce(F.col("id").isin(list(large)), F.lit(False))
    found = search_large(samples.filter(is_large), variables, dataset, settings, start, {str(k): v for k, v in large.items() if v is not None})
    if not known["small"]:
        return found
    return found.unionByName(search_small(samples.filter(~is_large).select("id", *variables, "y"), variables, dataset, settings, start))


def search_small(rows: DataFrame, variables: list[str], dataset: int, settings: Settings, start: dict[str, list[str]], spreads: dict[str, float] | None = None) -> DataFrame:
    """An island a task. ``rows``: id, the variables, y, or points if ``spreads``, the variances of all their targets, are given."""
    cut = rows.withColumn("o_", F.xxhash64(*variables, *(["y"] if spreads is None else [])))
    copies = cut.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(settings.islands - 1))))

    def evolve(part: pd.DataFrame) -> pd.DataFrame:
        problem, island = part["id"].iloc[0], int(part["island"].iloc[0])
        part = part.sort_values(["o_", "y"], kind="stable")
        counts, within = (None, 0.0) if spreads is None else (part[sums.WEIGHTS[0]].to_numpy(float), float(part[sums.WEIGHTS[1]].sum()))
        isle = Island(variables, part[variables].to_numpy(float).T, part["y"].to_numpy(float), settings, stream(settings, problem, dataset, island), (spreads or {}).get(problem), counts, within)
        isle.run([parse(t) for t in start.get(problem, [])])
        out = [(problem, dataset, island, size, loss, show(n)) for size, (loss, n) in sorted(isle.front.items())]
        return pd.DataFrame(out, columns=["id", "dataset", "island", "complexity", "loss", "equation"])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(spreads or {}) * settings.islands)  # a few points are long work
    return copies.repartitionByRange(n, "id", "island").groupBy("id", "island").applyInPandas(evolve, FRONT)


def search_large(samples: DataFrame, variables: list[str], dataset: int, settings: Settings, start: dict[str, list[str]], spreads: dict[str, float]) -> DataFrame:
    """The same for datasets of any size, by points. Rows whose target isn't finite are left out."""
    rows = samples.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("grp"), *(F.col(f"`{v}`").cast("double").alias(v) for v in variables), F.col("y").cast("double").alias("y"))
    kept = sums.points(rows, variables)
    many = {r["id"] for r in kept.groupBy("id").count().filter(F.col("count") > MOST_ROWS).collect()}  # a problem each
    few = {k: v for k, v in spreads.items() if k not in many}
    found = [search_small(kept.filter(F.col("id").isin(list(few))).drop("grp"), variables, dataset, settings, start, few)] if few else []
    if many:
        found.append(search_by_scans(kept.filter(F.col("id").isin(list(many))), variables, dataset, settings, start, {k: spreads[k] for k in many}))
    return reduce(DataFrame.unionByName, found) if found else samples.sparkSession.createDataFrame([], FRONT)


def search_by_scans(kept: DataFrame, variables: list[str], dataset: int, settings: Settings, start: dict[str, list[str]], spreads: dict[str, float]) -> DataFrame:
    """No task holds a dataset. The driver carries the populations, formulas only; all islands go on together, and a round is one scan that
    gives the sums of every formula that one of them asks for."""
    isles = {(problem, k): Island(variables, None, None, settings, stream(settings, problem, dataset, k), v) for problem, v in sorted(spreads.items()) for k in range(settings.islands)}
    steps = {key: isle.steps([parse(t) for t in start.get(key[0], [])]) for key, isle in isles.items()}
    asked = {key: next(s) for key, s in steps.items()}
    while asked:
        answers = answered(kept, variables, {key: (isles[key], nodes) for key, nodes in asked.items()})
        asked = {}
        for key, found in answers.items():
            try:
                asked[key] = steps[key].send(found)
            except StopIteration:
                pass
    out = [(problem, dataset, k, size, loss, show(n)) for (problem, k), isle in isles.items() for size, (loss, n) in sorted(isle.front.items())]
    return kept.sparkSession.createDataFrame(out, FRONT)


def answered(rows: DataFrame, variables: list[str], asked: dict[tuple[str, int], tuple[Island, list[tuple[str, Node]]]]) -> dict[tuple[str, int], list]:
    """Losses and tuned formulas, in the order asked for, by rounds of sums."""
    out, works = {key: [math.inf if kind == "loss" else n for kind, n in nodes] for key, (_, nodes) in asked.items()}, []
    for key, (isle, nodes) in asked.items():
        for i, (kind, node) in enumerate(nodes):
            p = isle.prepared(node) if kind == "tune" else Prepared(node, tuple(variables), (), (), (), (), {})
            try:
                if p is None:
                    continue
                sums.Evaluator(p)
            except (FormulaError, OverflowError):
                continue
            w = sums.Work(key[0], 0, f"{key[1]}|{i}", sums.Bound(**vars(p)))
            w.states = sums.starts(w.prepared, range(1), 0, "", False, 0)
            works.append((key, i, kind, w))
    sums.settle(rows, [w for _, _, _, w in works], [*variables, "y", *sums.WEIGHTS], False, sums.ROUNDS)
    for key, i, kind, w in works:
        if sums.good(w.states[0], w):
            s = w.states[0]
            out[key][i] = s.sums.sse / w.n if kind == "loss" else substitute(w.prepared.tree, dict(zip(w.prepared.parameters, (float(v) for v in s.x))))
    return out


def front(found: DataFrame) -> DataFrame:
    """The best formula of each complexity, and of those the Pareto front with its scores."""
    best = found.groupBy("id", "dataset", "complexity").agg(F.min_by(F.struct("loss", "equation"), F.struct("loss", "equation")).alias("b")).select("id", "dataset", "complexity", "b.*")
    return scored_front(best, ["id", "dataset"]).filter("on_front").drop("on_front", "score").transform(lambda d: scored_front(d, ["id", "dataset"])).drop("on_front")


def generalised(equations: DataFrame, formula: str = "equation") -> DataFrame:
    """``equations`` with para_eq, para_list and orgpara_list."""
    new = [T.StructField("para_eq", T.StringType()), T.StructField("para_list", T.ArrayType(T.StringType())), T.StructField("orgpara_list", T.ArrayType(T.DoubleType()))]
    kinds = T.StructType([*equations.schema.fields, *new])

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [generalise(parse(t)) for t in part[formula]]
            yield part.assign(para_eq=[show(t) for t, _, _ in out], para_list=[p for _, p, _ in out], orgpara_list=[v for _, _, v in out])

    return equations.mapInPandas(of, kinds)


def complexities(formulas: DataFrame, formula: str) -> DataFrame:
    """``formulas`` with the weighted number of nodes as ``complexity``; null for a text that is no formula."""
    kinds = T.StructType([*formulas.schema.fields, T.StructField("complexity", T.LongType())])

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def size(text: str) -> int | None:
            try:
                return complexity(parse(text))
            except FormulaError:
                return None

        for part in parts:
            yield part.assign(complexity=pd.array([size(t) for t in part[formula]], "Int64"))

    return formulas.mapInPandas(of, kinds)


def discover(samples: DataFrame, variables: list[str], datasets: list[int], settings: Settings = Settings(), parameters: dict[str, dict[int, dict[str, float]]] | None = None, done: DataFrame | None = None, top: int = 10, seeds: dict[str, list[str]] | None = None) -> DataFrame:
    """The summary of all datasets: for each the lowest losses of its front, generalised.

    ``samples``: id, grp, the variables, y. ``parameters`` (id, dataset, name to value) turns on the mode with parameter features.
    ``done`` (id, dataset) is skipped. The loop over datasets is serial, as each starts from the front of the one before, the first
    one from ``seeds`` (id to equations).
    """
    out, seeds = None, dict(seeds or {})
    for d in datasets:
        rows = samples.filter(F.col("grp") == d)
        if done is not None:
            rows = rows.join(done.filter(F.col("dataset") == d).select("id"), "id", "left_anti")
        features = list(variables)
        if parameters:
            names = sorted({n for by in parameters.values() for n in by.get(d, {})})
            for n in names:
                value = F.create_map(*(F.lit(v) for k, by in parameters.items() if d in by and n in by[d] for v in (k, by[d][n])))
                rows = rows.withColumn(n, F.element_at(value, F.col("id")))
            features += names
        # Found once: the front is read for the next dataset's start and for the summary.
        found = sinks.between(front(search_dataset(rows, features, d, replace(settings, seed=settings.seed + d), seeds)))
        seeds = {r["id"]: list(r["e"]) for r in found.groupBy("id").agg(F.collect_list("equation").alias("e")).collect()}  # a front a problem
        best = generalised(lowest_loss(found, ["id", "dataset"], top, first="complexity").drop("rank"))
        out = best if out is None else out.unionByName(best)
    return out
