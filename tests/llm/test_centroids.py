"""Operator 11 against full scans, and its bounds."""

import hashlib
import math

import numpy as np
import pytest

from fitloom.llm import centroids

KIND = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dims):
    """(vec_id, cluster, distance) and the centroids, by full scans in Python integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, x), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for i in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == i]
            c[i] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def random_rows(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread, (7, dims))
    x = (middles[rng.integers(0, 7, n)] + rng.normal(0, 0.2, (n, dims))).astype(np.float32)
    return [(i, [float(e) for e in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("k", "rounds", "dims"), [(1, 2, 3), (2, 3, 2), (12, 5, 4), (40, 5, 6)])
def test_is_a_full_scan(spark, k, rounds, dims):
    rows = random_rows(400, dims, k) + [(1000 + i, [0.5] * dims) for i in range(50)]  # a third of equal vectors would be no other case
    found, c = centroids.clustered(spark.createDataFrame(rows, KIND), k, rounds, dims)
    expected, want = brute(rows, k, rounds, dims)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == sorted(expected)
    assert c.tolist() == want


def test_bounds_never_lie():
    """Centroids on a walk: after each step the first of the list is the nearest, and each bound holds."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-60, 60, (600, 5)), rng.integers(-60, 60, (16, 5))
    bounds = centroids.Bounds.unknown(len(x), 4)
    moved, worked = None, []
    for step in range(12):
        if moved is not None:
            if step == 6:
                bounds.shorten(2)
            bounds.carry(moved)
        worked.append(bounds.assign(x, c)[1].sum())
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert (bounds.near[:, 0] == d.argmin(axis=1)).all()
        root = np.sqrt(d)
        rows = np.arange(len(x))
        assert (bounds.upper >= root[rows, bounds.near[:, 0]]).all()
        assert (bounds.lower <= np.take_along_axis(root, bounds.near[:, 1:], 1) + 1e-9).all()
        outside = root.copy()
        np.put_along_axis(outside, bounds.near, np.inf, 1)
        assert (bounds.rest <= outside.min(axis=1) + 1e-9).all()
        new = c + rng.integers(-2, 3, c.shape)
        moved, c = np.sqrt(((new - c) ** 2).sum(1)) * (1 + centroids.EPS), new
    assert worked[0] == 16 * len(x) and max(worked[1:]) < 12 * len(x)


def test_equal_distances_go_to_the_smaller_number():
    bounds = centroids.Bounds.unknown(1, 1)
    c = np.array([[2, 0], [-2, 0], [0, 2], [0, -2]])
    bounds.assign(np.array([[0, 0]]), c)
    assert bounds.near[0].tolist() == [0, 1]
    bounds.carry(np.array([0.0, 0.0, 1.0, 0.0]))
    bounds.assign(np.array([[0, 0]]), c)
    assert bounds.near[0, 0] == 0


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-centroids.LIMIT, centroids.LIMIT, (5, 64)), rng.integers(-centroids.LIMIT, centroids.LIMIT, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert centroids.squared(x, c).tolist() == want == centroids.paired(x, np.broadcast_to(c, (5, 3, 64))).tolist()
    assert max(map(max, want)) < 1 << 63


def test_shorter_lists():
    assert centroids.shorter({0: 990, 3: 10}, 10, 5) == 5
    assert centroids.shorter({0: 900, 7: 90, 11: 10}, 10, 5) == 7
    assert centroids.shorter({11: 100}, 10, 5) == 10


def test_what_is_kept(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.1]), (3, None), (4, [None, 0.2]), (5, [nan, 0.2]), (6, [-inf, 0.1]), (None, [-0.1, 0.3]), (7, [1e38, -1e38]), (8, [])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND + ", cluster string, v string")
    found, c = centroids.clustered(df, 40, 5, 2)
    got = sorted(((r["vec_id"] or 0), r["distance"]) for r in found.collect())
    assert got == [(0, 0), (1, 0), (1, 0), (7, 0)] and len(c) == 4
    out = centroids.assigned(spark.createDataFrame([(9, [0.25] * 64), (9, [0.25] * 64)], KIND)).collect()
    assert [(r["vec_id"], r["cluster"], r["inertia"]) for r in out] == [(9, 0, 0)] * 2
    assert {r["centroid_sha256"] for r in out} == {hashlib.sha256(",".join(["64"] * 64).encode()).hexdigest()}


def test_of_nothing(spark):
    assert centroids.assigned(spark.createDataFrame([], KIND)).collect() == []
    assert centroids.assigned(spark.createDataFrame([(1, [1.0])], KIND)).collect() == []


def test_most_distances_are_not_worked_out(spark):
    rows = random_rows(500, 8, 3, spread=3.0)
    found, _ = centroids.clustered(spark.createDataFrame(rows, KIND), 24, 5, 8)
    assert sum(r["worked"] for r in found.collect()) < 500 * 24 / 2
