"""Datasets from problem specifications: sampling, shifted ranges, noise. Samples of an (id, group) come from a seed of its own, noise from the
row alone, so neither depends on the number of tasks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import counters
from fitloom.functions.compile import to_numpy
from fitloom.functions.expr import FormulaError, parse

SAMPLES = "variant string, id string, grp int, row_idx long, x map<string,double>, y double"


def base_seed(problem: str, group: int, word: str = "BASE") -> int:
    """The first eight bytes of a SHA-256, little-endian."""
    return int.from_bytes(hashlib.sha256(f"{word}|{problem}|{group}".encode()).digest()[:8], "little")


def accepted_rows(value, ranges: list[tuple[float, float]], parameters: list[float], target: tuple[float, float] | None, n: int, rng: np.random.Generator, batch, most: int) -> tuple[np.ndarray, int]:
    """The first n rows of uniform draws that are finite and, with ``target``, within it; and how many were drawn. ``batch(missing, drawn)`` is the next batch's size."""
    kept, have, drawn = [], 0, 0
    if target:
        tol = 1e-10 * max(1.0, abs(target[0]), abs(target[1]))
        lo, hi = target[0] - tol, target[1] + tol
    while have < n and drawn < most:
        size = int(min(batch(n - have, drawn), most - drawn))
        columns = [np.full(size, a) if a == b else rng.uniform(a, b, size) for a, b in ranges]
        y = np.broadcast_to(value(*parameters, *columns), size)
        good = np.isfinite(y)
        if target:
            good &= (y >= lo) & (y <= hi)
        rows = np.column_stack([*columns, y])[good][: n - have]
        kept.append(rows)
        have += len(rows)
        drawn += size
    return np.concatenate(kept) if kept else np.empty((0, len(ranges) + 1)), drawn


def generate(specs: DataFrame, n: int = 5000, kind: str = "base", seed: int = 0, draws: int = 50, variant: str | None = None, groups: int | None = None) -> DataFrame:
    """Samples of every problem and group. ``base`` draws until the target range gives n rows (at most 10,000 batches); ``shift`` takes
    finite rows of shifted ranges, at most ``draws * n`` draws. A group that can't be filled is an error.

    ``specs``: id, generation_formula, variables, params, constants, para_values, var_ranges, target_ranges.
    """
    name = variant or kind
    cells = specs.select("id", "generation_formula", "variables", F.col("params.name").alias("names"), "constants", F.posexplode("para_values").alias("grp", "values"), "var_ranges", "target_ranges")
    cells = cells.filter(F.col("grp") < groups) if groups else cells
    cells = cells.select("id", "generation_formula", "variables", "names", "constants", "grp", "values", F.element_at("var_ranges", F.col("grp") + 1).alias("ranges"), F.get("target_ranges", F.col("grp")).alias("target"))

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                variables, parameters, grp = list(r.variables), list(r.names), int(r.grp)
                constants = {k: v for k, v in (dict(r.constants) if r.constants is not None else {}).items()}
                tree = parse(r.generation_formula, "generate" if kind == "base" else "shift", {*variables, *parameters, *constants})
                values = [float(v) for v in r.values]
                if len(values) != len(parameters) or len(r.ranges) != len(variables):
                    raise FormulaError(f"{r.id}/{grp}: vectors don't fit the names")
                ranges = [(float(x["lo"]), float(x["hi"])) for x in r.ranges]
                target = (float(r.target["lo"]), float(r.target["hi"])) if kind == "base" and r.target is not None else None
                if kind == "base":
                    rng = np.random.default_rng(base_seed(r.id, grp))
                    size, most = (lambda missing, _: max(4096, 2 * missing)), 10_000 * max(4096, 2 * n)
                else:
                    rng = np.random.default_rng(np.random.SeedSequence([seed, zlib.crc32(r.id.encode()), grp]))
                    size, most = (lambda missing, _: max(2 * missing, 1024)), max(n, n * draws)
                rows, drawn = accepted_rows(to_numpy(tree, [*parameters, *variables], constants), ranges, values, target, n, rng, size, most)
                if len(rows) < n:
                    raise ValueError(f"{r.id}/{grp}: {len(rows)} of {n} rows after {drawn} draws")
                yield pd.DataFrame({"variant": name, "id": r.id, "grp": grp, "row_idx": np.arange(n), "x": [dict(zip(variables, x)) for x in rows[:, :-1].tolist()], "y": rows[:, -1]})

    return cells.repartition("id", "grp").mapInPandas(make, SAMPLES)


def noise_key(level: str | float | Decimal) -> str:
    """0.10 and 0.1 are one level."""
    return format(Decimal(str(level)).normalize(), "f")


def add_noise(samples: DataFrame, level: str | float, mode: str = "relative", seed: int = 0, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``samples`` with noisy y. ``relative``: y (1 + N(0, level)); ``absolute``: y + N(0, level); ``dataset-std``: the level times the
    group's population deviation (0 for a group of one). Null and NaN targets pass through. With ``start`` only groups start..stop are taken,
    numbered from 0. The draw of a row depends on seed, level, id, group and row_idx only, so no group meets in a task for it; rows of a
    group that share a row_idx share a draw."""
    if mode not in ("relative", "absolute", "dataset-std"):
        raise ValueError(f"unknown mode {mode}")
    key, amount = noise_key(level), float(Decimal(str(level)))
    taken = samples.filter(F.col("grp").between(start, stop if stop is not None else 1 << 30)) if start is not None else samples
    stream = F.concat_ws("|", F.lit(str(seed)), F.lit(key), F.col("id").cast("string"), F.col("grp").cast("string"))
    drawn = counters.normals(taken, stream, F.col("row_idx"), "draw_")
    there = F.col("y").isNotNull() & ~F.isnan("y")
    if mode == "dataset-std":
        spread = taken.filter(there).groupBy("id", "grp").agg(F.stddev_pop("y").alias("spread_"))
        drawn = drawn.join(F.broadcast(spread), ["id", "grp"], "left")  # a row a dataset
    noise = {"relative": F.col("y") * (1.0 + amount * F.col("draw_")), "absolute": F.col("y") + amount * F.col("draw_"), "dataset-std": F.col("y") + amount * F.col("spread_") * F.col("draw_") if mode == "dataset-std" else None}[mode]
    grp = (F.col("grp") - start).cast("int") if start is not None else F.col("grp")
    return drawn.select(F.lit(f"noise_{key}").alias("variant"), "id", grp.alias("grp"), "row_idx", "x", F.when(there, noise).otherwise(F.col("y")).alias("y"))


def hashed_noise(y: Column, level: float, *key: Column) -> Column:
    """Relative noise from a hash of the key alone, in columns: the sum of twelve uniforms less six stands for a normal draw."""
    total = sum((F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(k)), *key)), 1, 8), 16, 10).cast("double"), F.lit(65536.0)) / 65536.0 for k in range(12)), F.lit(0.0))
    return y * (1.0 + level * (total - 6.0))


def summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("variant", "id", "grp").agg(F.count("*").alias("rows"), F.min("y").alias("least"), F.max("y").alias("most"))
