"""Fits by sums against fits of whole groups, and the trust region against known optima."""

import numpy as np
import pytest

from fitloom.operators import fitting, sums
from fitloom.operators.trust import Model, State, Sums, inside, minimum

INF = np.inf
FORMULAS = "id string, formula_id string, formula string, para_list array<string>, orgpara_list array<double>"


def problem(f, jacobian, y):
    def at(p):
        with np.errstate(all="ignore"):
            r, j = f(p) - y, jacobian(p)
            return Sums(float(r @ r), j.T @ j, j.T @ r)

    return at


X = np.linspace(0.5, 10, 300)
POWER = (lambda p: p[0] * X ** p[1] + p[2], lambda p: np.stack([X ** p[1], p[0] * X ** p[1] * np.log(X), np.ones_like(X)], 1))


@pytest.mark.parametrize("start", [(1, 1, 0), (0.1, 3, 100), (10, -1, 5)])
def test_recovers(start):
    point, sse = minimum(problem(*POWER, POWER[0]((2, 1.5, 3))), np.array(start, float), np.full(3, -INF), np.full(3, INF))
    assert np.allclose(point, (2, 1.5, 3), atol=1e-6) and sse < 1e-12


@pytest.mark.parametrize("seed", range(6))
def test_boxes_of_linear_problems(seed):
    """Against projected gradients, from corners, from the middle and from outside."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(80, 4)), rng.normal(size=80)
    free = np.linalg.lstsq(a, b, rcond=None)[0]
    lower, upper = np.minimum(free, 0) * rng.choice([0.3, 2], 4) - 0.001, np.maximum(free, 0) * rng.choice([0.3, 2], 4) + 0.001
    p = np.zeros(4)
    for _ in range(20000):
        p = np.clip(p - 0.004 * (a.T @ (a @ p - b)), lower, upper)
    for start in (lower, upper, (lower + upper) / 2, upper + 5):
        point, sse = minimum(problem(lambda p: a @ p, lambda p: a, b), start, lower, upper)
        assert np.all(point >= lower) and np.all(point <= upper)
        assert np.allclose(point, p, atol=1e-5) and sse == pytest.approx(float(((a @ p - b) ** 2).sum()), rel=1e-8)


def test_a_curved_valley_in_a_box():
    def rosenbrock(p):
        j = np.array([[-20 * p[0], 10], [-1, 0]])
        r = np.array([10 * (p[1] - p[0] ** 2), 1 - p[0]])
        return Sums(float(r @ r), j.T @ j, j.T @ r)

    assert np.allclose(minimum(rosenbrock, np.array([-1.2, 1.0]), np.full(2, -INF), np.full(2, INF))[0], 1)
    assert np.allclose(minimum(rosenbrock, np.array([-1.2, 1.0]), np.array([-2.0, -2]), np.array([0.5, 2]))[0], (0.5, 0.25), atol=1e-5)


def test_the_best_finite_point_is_kept():
    """Beyond 2 nothing is finite; the optimum lies there."""

    def at(p):
        r = np.array([p[0] - 3.0]) if p[0] < 2 else np.array([np.nan])
        return Sums(float(r @ r), np.eye(1), r)

    point, sse = minimum(at, np.array([0.0]), np.array([-INF]), np.array([INF]))
    assert 1 < point[0] < 2 and np.isfinite(sse)
    assert minimum(at, np.array([5.0]), np.array([-INF]), np.array([INF]))[1] == INF


def test_steps_stay_inside():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = int(rng.integers(1, 5))
        j, z = rng.normal(size=(6, k)), rng.uniform(0.01, 0.99, k)
        model = Model(z, j.T @ rng.normal(size=6), j.T @ j, np.zeros(k), np.ones(k))
        for radius in (1e-3, 0.3, 10.0):
            step, size, gain = model.step(radius)
            assert np.all(z + step >= -1e-12) and np.all(z + step <= 1 + 1e-12) and size <= radius * (1 + 1e-6) and gain >= 0
    assert np.array_equal(inside(np.array([1.0]), np.array([1.0]), np.array([1.0])), [1.0])


def test_without_parameters_a_state_settles():
    state = State.begin(np.array([]), np.array([]), np.array([]))
    state.learn([Sums(3.0, np.zeros((0, 0)), np.zeros(0))])
    assert state.settled and state.sums.sse == 3.0


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, grp, n in (("A", 0, 700), ("A", 1, 40), ("B", 0, 300), ("C", 0, 5)):
        x = rng.uniform(0.5, 6, n)
        y = {"A": (grp + 2) * x**1.5 + 3, "B": 4 * np.exp(-0.3 * x) + 1, "C": np.full(n, 0.1)}[name] + rng.normal(0, 0.05, n) * (name != "C")
        rows += [(name, grp, float(a) if i % 50 else float("nan"), float(b) if i % 70 else None) for i, (a, b) in enumerate(zip(x, y))]
    rows += [("D", 0, float("nan"), 1.0), ("E", 0, 1.0, 2.0)]
    return spark.createDataFrame(rows, "id string, grp int, x double, y double")


def same(a, b):
    key = lambda r: (r["id"], r["formula_id"], r["grp"])
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [(key(r), r["ok"], r["error"], r["retry_used"]) for r in a] == [(key(r), r["ok"], r["error"], r["retry_used"]) for r in b]
    for x, y in zip(a, b):
        assert x["mse"] == pytest.approx(y["mse"], rel=1e-6, abs=1e-20) and x["r2"] == pytest.approx(y["r2"], abs=1e-6)
        assert list(x["params"]) == pytest.approx(list(y["params"]), rel=1e-3, abs=1e-4)


def test_equal_to_fits_of_whole_groups(spark, samples):
    each = [("power", "p0*x**p1 + p2", ["p0", "p1", "p2"], [1.0, 1.0, 1.0]), ("decay", "p0*exp(p1*x) + p2", ["p0", "p1", "p2"], [1.0, -0.1, 0.0]), ("fixed", "0.1 + 0*x", [], []), ("bad", "p0*(x", ["p0"], [1.0]), ("lost", "p0*z", ["p0"], [1.0])]
    formulas = spark.createDataFrame([(i, *f) for i in "ABD" for f in each] + [("C", *each[2]), ("E", "flat", "p0 + 0*x", ["p0"], [1.0])], FORMULAS)
    same(sums.fit_sums(samples, formulas, ["x"]), fitting.fit_groups(samples, formulas, ["x"]))


def test_retries_and_bounds(spark, samples):
    formulas = spark.createDataFrame([("A", "log", "p0*log(p1*x)", ["p0", "p1"], [1.0, -1.0]), ("A", "free", "k*x**m", [], [])], FORMULAS)
    one = [f for f in sums.fit_sums(samples, formulas.filter("formula_id = 'log'"), ["x"], retries=4).collect()]
    assert all(r["attempts"] > 1 and r["retry_used"] for r in one)
    limits = {"k": (0.5, 2.5), "m": (0.5, 1.4)}
    options = dict(ranges=limits, bounded=True, protected=True, retries=2, strict=False)
    found = sums.fit_sums(samples, formulas.filter("formula_id = 'free'"), ["x"], **options)
    same(found, fitting.fit_groups(samples, formulas.filter("formula_id = 'free'"), ["x"], **options))
    assert all(r["params"][1] == pytest.approx(1.4, abs=1e-6) for r in found.collect())


def test_parts(spark, samples, monkeypatch):
    formulas = spark.createDataFrame([(i, f"f{k}", f"p0*x + {k}", ["p0"], [1.0]) for i in "AB" for k in range(6)], FORMULAS)
    whole = sums.fit_sums(samples, formulas, ["x"])
    monkeypatch.setattr(sums, "MOST_FITS", 5)
    same(sums.fit_sums(samples, formulas, ["x"]), whole)
    assert sums.fit_sums(samples, formulas.limit(0), ["x"]).count() == 0
