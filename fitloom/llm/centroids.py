"""Operator 11: Lloyd's clustering in integers, with Drake's adaptive bounds instead of most distances.

Each vector keeps its nearest centroids in a list, the first of them its own. It has an upper bound of the distance to its own centroid, a lower
bound for each other one of the list, and one lower bound for all the rest. When centroids move, the bounds move by as much. A vector whose
upper bound lies under all its lower bounds stays where it is. Else its own distance is taken exactly; then the start of the list that the
bounds leave in doubt is scanned and put in order; and only if the bound of the rest is in doubt, all centroids are. Components are
integers, distances are exact, bounds are rounded outwards and an equal bound counts as doubt, so the result is that of a full scan.
The list begins with a quarter of the centroids and gets shorter, down to an eighth, while the shorter one does for ``ENOUGH`` of the vectors.

A round reads one table in the shared folder and writes the next one (integers, list, bounds); the one before is deleted. The driver holds the
centroids, k times the number of components, and nothing of the vectors; sums are partial aggregates, so a cluster of any size is summed.

Kept are vectors of exactly ``dims`` components, none null or not finite; others, and null vectors, have no row. Components beyond
2**27 in size after scaling count as that, as a squared distance would not fit a long. Rows that share an id are vectors of their own;
where they tie for a first centroid the lesser components come first. A null id is hashed as an empty text. Fewer vectors than
centroids: each is a first centroid; an empty table gives an empty one. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import clean, made, quoted, reader, scratch

SCALE, SALT = 256, 2
LIMIT = 1 << 27
#: Share of the vectors that a shorter list must do for.
ENOUGH = 0.99
#: Vectors that are worked on at once.
ROWS = 4096
#: Outward rounding of what is worked out in doubles.
EPS = 1e-12


def whole_numbers(vector: Column, dims: int) -> tuple[Column, Column]:
    """(is the vector kept, its components as integers)."""
    x = vector.cast("array<double>")
    kept = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    scaled = lambda e: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), e * SCALE))).cast("int")
    return F.coalesce(kept, F.lit(False)), F.transform(x, scaled)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``; in doubles where all steps stay under 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if 4 * most * most * x.shape[1] < 1 << 53 else x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of x[i] to each of c[i]."""
    gap = c - x[:, None, :]
    return (gap * gap).sum(2)


def over(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def under(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Bounds:
    """The lists and bounds of some vectors."""

    def __init__(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.near, self.upper, self.lower, self.rest = near, upper, lower, rest

    @classmethod
    def unknown(cls, n: int, size: int) -> Bounds:
        """Nothing is certified, so that all is scanned."""
        return cls(np.zeros((n, size + 1), np.int32), np.full(n, np.inf), np.full((n, size), -np.inf), np.full(n, -np.inf))

    def shorten(self, size: int) -> None:
        if size < self.lower.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, size:].min(axis=1))
            self.near, self.lower = self.near[:, : size + 1], self.lower[:, :size]

    def carry(self, moved: np.ndarray) -> None:
        """The centroids have moved by ``moved``."""
        self.upper = (self.upper + moved[self.near[:, 0]]) * (1 + EPS)
        drop = lambda bound, by: bound - by - (np.abs(bound) + by) * EPS
        self.lower, self.rest = drop(self.lower, moved[self.near[:, 1:]]), drop(self.rest, moved.max(initial=0.0))

    def assign(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put each vector's nearest centroid first. (places of the list that were in doubt, distances worked out) of each vector."""
        n, size = self.lower.shape
        doubt, worked = np.zeros(n, np.int32), np.zeros(n, np.int32)
        # From place z on, the list and the rest are at least so far away.
        bars = np.minimum.accumulate(np.c_[self.lower, self.rest][:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(~(self.upper < bars[:, 0]))
        known = open_[np.isfinite(self.upper[open_])]
        self.upper[known] = np.sqrt(paired(x[known], c[self.near[known, :1]])[:, 0].astype(np.float64)) * (1 + EPS)
        worked[known] = 1
        open_ = open_[~(self.upper[open_] < bars[open_, 0])]
        clear = self.upper[open_, None] < bars[open_]
        place = np.where(clear.any(axis=1), clear.argmax(axis=1), size + 1)
        doubt[open_] = place
        for z in np.unique(place):
            at = open_[place == z]
            if z <= size:
                self.scan(at, x[at], c, int(z))
                worked[at] += int(z) + 1
            else:
                self.scan_all(at, x[at], c)
                worked[at] += len(c)
        return doubt, worked

    def scan(self, at: np.ndarray, x: np.ndarray, c: np.ndarray, z: int) -> None:
        """The first z + 1 of the list, in order of distance and number."""
        near = np.sort(self.near[at, : z + 1], axis=1)
        d = paired(x, c[near])
        order = np.argsort(d, axis=1, kind="stable")
        self.near[at, : z + 1] = np.take_along_axis(near, order, 1)
        self.keep(at, np.take_along_axis(d, order, 1))

    def scan_all(self, at: np.ndarray, x: np.ndarray, c: np.ndarray) -> None:
        size = self.lower.shape[1]
        d = squared(x, c)
        order = np.argsort(d, axis=1, kind="stable")[:, : size + 2]
        d = np.take_along_axis(d, order, 1)
        self.near[at] = order[:, : size + 1]
        self.keep(at, d[:, : size + 1])
        self.rest[at] = np.sqrt(d[:, size + 1].astype(np.float64)) * (1 - EPS) if d.shape[1] > size + 1 else np.inf

    def keep(self, at: np.ndarray, d: np.ndarray) -> None:
        root = np.sqrt(d.astype(np.float64))
        self.upper[at] = root[:, 0] * (1 + EPS)
        self.lower[at, : d.shape[1] - 1] = root[:, 1:] * (1 - EPS)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def square_of(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(kind) if len(flat) else np.zeros((rows, 0), kind)


def assigner(centroids: np.ndarray, moved: np.ndarray | None, size: int, last: bool):
    """Of batches of the state: the next state, or with ``last`` (vec_id, cluster, distance)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                n = rows.num_rows
                x = square_of(rows.column("v"), n, np.int64)
                if moved is None:
                    bounds = Bounds.unknown(n, size)
                else:
                    bounds = Bounds(square_of(rows.column("near"), n, np.int32), rows.column("upper").to_numpy().astype(float), square_of(rows.column("lower"), n, float), rows.column("rest").to_numpy().astype(float))
                    bounds.shorten(size)
                    bounds.carry(moved)
                doubt, worked = bounds.assign(x, centroids)
                if last:
                    distance = paired(x, centroids[bounds.near[:, :1]])[:, 0]
                    yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(bounds.near[:, 0], pa.int32()), pa.array(distance), pa.array(worked, pa.int32())], ["vec_id", "cluster", "distance", "worked"])
                else:
                    # As floats, each rounded outwards.
                    new = [lists(bounds.near, pa.int32()), pa.array(over(bounds.upper)), lists(under(bounds.lower), pa.float32()), pa.array(under(bounds.rest)), pa.array(doubt, pa.int32()), pa.array(worked, pa.int32())]
                    yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), *new], ["vec_id", "v", "near", "upper", "lower", "rest", "doubt", "worked"])

    return of


def shorter(counts: dict[int, int], size: int, least: int) -> int:
    """The least length of the list that does for ``ENOUGH`` of the vectors. ``counts``: vectors by places in doubt."""
    total, so_far = sum(counts.values()), 0
    for place in range(size + 1):
        so_far += counts.get(place, 0)
        if so_far >= ENOUGH * total:
            return min(size, max(least, place))
    return size


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, worked) of each kept vector, the final centroids). ``worked``: the distances that the last assignment
    worked out for a vector, of k."""
    spark = vectors.sparkSession
    kept, whole = whole_numbers(F.col(quoted(vector)), dims)
    rows = vectors.filter(kept).select(F.col(quoted(key)).alias("vec_id"), whole.alias("v"))
    name = F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    kind = vectors.schema[key].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, worked int"), centroids
    size, least = min(len(centroids) - 1, math.ceil(len(centroids) / 4)), math.ceil(len(centroids) / 8)
    state = f"vec_id {kind}, v array<int>, near array<int>, upper float, lower array<float>, rest float, doubt int, worked int"
    moved, mark = None, made()
    for _ in range(rounds):
        path = scratch(spark, "centroids")
        rows.mapInArrow(assigner(centroids, moved, size, False), state).write.option("compression", "zstd").parquet(path)
        rows = reader(spark).schema(state).parquet(path)
        clean(spark, mark, {path})
        sums = rows.groupBy(F.element_at("near", 1).alias("cluster")).agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims))).collect()  # a row a centroid
        size = shorter({r["doubt"]: r["count"] for r in rows.groupBy("doubt").count().collect()}, size, least)
        new = centroids.copy()
        for r in sums:
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        gap = new - centroids
        moved, centroids = np.sqrt((gap * gap).sum(1).astype(np.float64)) * (1 + EPS), new
    return rows.mapInArrow(assigner(centroids, moved, size, True), f"vec_id {kind}, cluster int, distance long, worked int"), centroids


def assigned(vectors: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """The query's columns. An inertia that does not fit a long ends the job."""
    spark = vectors.sparkSession
    mark = made()
    found, centroids = clustered(vectors, k, rounds)
    path = scratch(spark, "clusters")
    found.write.option("compression", "zstd").parquet(path)
    found = reader(spark).schema(found.schema).parquet(path)
    clean(spark, mark, {path})
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    total = sum(sums.values())
    about = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("worked").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The same by full scans."""
    steps = [
        f"""kept as materialized (select row_number() over (order by vec_id, embedding) as rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims})""",
        "x as materialized (select rid, i, v[i] as x from kept, range(1, " + str(dims + 1) + ") t(i))",
        f"f as materialized (select row_number() over (order by sha256('{SALT}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 as cluster, v from kept)",
        f"c0 as materialized (select cluster, i, v[i] as c from f, range(1, {dims + 1}) t(i) where cluster < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} as (select rid, cluster, sum((x - c) * (x - c)) as d from x join c{r} using (i) group by rid, cluster)")
        steps.append(f"a{r} as materialized (select rid, first(cluster order by d, cluster) as cluster, min(d) as d from d{r} group by rid)")
        if r < rounds:
            steps.append(f"m{r} as (select cluster, i, sum(x) as s, count(*) as n from a{r} join x using (rid) group by cluster, i)")
            steps.append(f"c{r + 1} as materialized (select cluster, i, (case when n is null then c else (s - ((s % n) + n) % n) // n end)::BIGINT as c from c{r} left join m{r} using (cluster, i))")
    steps.append(f"h as (select cluster, sha256(string_agg(c::VARCHAR, ',' order by i)) as centroid_sha256 from c{rounds} group by cluster)")
    return (
        "with " + ",\n".join(steps) + f"\nselect vec_id, a.cluster::INTEGER as cluster, a.d::BIGINT as distance, (sum(a.d) over (partition by a.cluster))::BIGINT as cluster_inertia, "
        f"(sum(a.d) over ())::BIGINT as inertia, centroid_sha256 from a{rounds} a join kept using (rid) join h on h.cluster = a.cluster"
    )
