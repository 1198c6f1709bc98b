"""Special functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions.scalars import bound

# Lanczos' approximation of the gamma function for g = 7 with nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction; it converges in some tens for what correlations ask of it, in the root of n for n rows.
STEPS = 400


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, x at least 1/2."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by a bounded fold that stands still once it has converged."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("out"), F.lit(False).alias("done"))

    def half(s: Column, top: Column) -> tuple[Column, Column]:
        return safe(1.0 + top / s["c"]), 1.0 / safe(1.0 + top * s["d"])

    def even(s: Column, m: Column) -> Column:
        c, d = half(s, m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m)))
        return F.struct(c.alias("c"), d.alias("d"), (s["out"] * c * d).alias("out"), s["done"].alias("done"))

    def odd(s: Column, m: Column) -> Column:
        c, d = half(s, -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0)))
        return F.struct(c.alias("c"), d.alias("d"), (s["out"] * c * d).alias("out"), (F.abs(c * d - 1.0) < 1e-15).alias("done"))

    both = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: F.array(F.struct(m.cast("double").alias("m"), F.lit(True).alias("even")), F.struct(m.cast("double").alias("m"), F.lit(False).alias("even")))))
    return F.aggregate(both, start, lambda s, i: F.when(s["done"], s).when(i["even"], even(s, i["m"])).otherwise(odd(s, i["m"])))["out"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised, for a and b of at least 1/2."""

    def inner(s: Column) -> Column:
        """The fraction converges fast on one side of its middle; beyond it the complement is taken."""
        front = F.exp(log_gamma(s["a"] + s["b"]) - log_gamma(s["a"]) - log_gamma(s["b"]) + s["a"] * F.ln(s["x"]) + s["b"] * F.ln(1.0 - s["x"]))
        part = front * beta_fraction(s["a"], s["b"], s["x"]) / s["a"]
        return F.when(s["swapped"], 1.0 - part).otherwise(part)

    swapped = x >= (a + 1.0) / (a + b + 2.0)
    sides = F.struct(F.when(swapped, b).otherwise(a).alias("a"), F.when(swapped, a).otherwise(b).alias("b"), F.when(swapped, 1.0 - x).otherwise(x).alias("x"), swapped.alias("swapped"))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(bound(sides, inner))


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided probability of a correlation at least as large among ``n`` pairs of unrelated values: Student's t with n - 2 degrees of freedom. NaN
    for less than three pairs; null where the correlation is."""
    df, rest = n.cast("double") - 2.0, 1.0 - F.least(r * r, F.lit(1.0))
    p = bound(F.struct((F.greatest(df, F.lit(1.0)) / 2.0).alias("a"), rest.alias("x")), lambda s: incomplete_beta(s["a"], F.lit(0.5), s["x"]))
    return F.when(r.isNull(), F.lit(None).cast("double")).when(df <= 0, F.lit(float("nan"))).when(rest <= 0, 0.0).otherwise(p)
