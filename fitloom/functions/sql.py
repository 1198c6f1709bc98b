"""The engine's functions by name, for queries that are written in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fitloom.functions.compile import to_numpy
from fitloom.functions.expr import parse
from fitloom.functions.scalars import ERROR_R2

#: Draws of a row of arguments at once, and how many batches without a finite value end it.
BATCH, TRIES = 4096, 1000


class FormulaSampler:
    """``sample_formula(key, formula, lo, hi, n)``: n rows (row_idx, x, y) of a formula of x, x uniform in its range, y finite; the stream
    is that of the key alone."""

    def eval(self, key: str, formula: str, lo: float, hi: float, n: int) -> Iterator[tuple[int, float, float]]:
        from fitloom.operators.generate import base_seed

        value, rng, have = to_numpy(parse(formula), ["x"]), np.random.default_rng(base_seed(key, 0)), 0
        for _ in range(TRIES):
            x = rng.uniform(lo, hi, BATCH) if lo < hi else np.full(BATCH, float(lo))
            y = np.broadcast_to(value(x), x.shape)
            for a, b in zip(x[np.isfinite(y)].tolist(), y[np.isfinite(y)].tolist()):
                if have == n:
                    return
                yield have, a, b
                have += 1
        if have < n:
            raise ValueError(f"{key}: {have} of {n} rows")


#: Scalar functions as SQL, which Spark puts into the plan of the query that names them; they take aggregates.
SCALARS = {
    "r2_of": f"(sse DOUBLE, sst DOUBLE) RETURNS DOUBLE RETURN CASE WHEN sst = 0 THEN CASE WHEN sse <= 1e-24 THEN 1D ELSE {ERROR_R2!r}D END ELSE 1 - sse / sst END",
    "nmse_of": "(sse DOUBLE, sst DOUBLE) RETURNS DOUBLE RETURN CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 0D ELSE double('NaN') END ELSE sse / sst END",
    "r2_strength": "(r2 DOUBLE) RETURNS DOUBLE RETURN CASE WHEN isnan(r2) THEN r2 ELSE least(-log10(greatest(1 - least(r2, 1D), 1e-15D)), 10D) END",
}


def register(spark: SparkSession) -> None:
    """``sample_formula`` as a table function, the rules of ``SCALARS`` as functions, in this session."""
    spark.udtf.register("sample_formula", udtf(FormulaSampler, returnType="row_idx: bigint, x: double, y: double"))
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
