"""Scalar functions of columns beside the formula language."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels of failed fits, the limit beyond which a value counts as one, and tolerances of the protected power.
ERROR_MSE, ERROR_R2, FAILED = 1e100, -1e100, 1e99
WHOLE = 1e-10


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(x: Column, places: int = 4) -> Column:
    """Half up, by a floor: unlike ``round`` it gives the same in all engines."""
    return F.floor(x * F.lit(10.0**places) + 0.5).cast("double") / F.lit(10.0**places)


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; NaN by zero."""
    r = a % F.when(b != 0, b)
    return F.when(b == 0, F.lit(float("nan"))).otherwise(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r))


def protected_power(base: Column, exponent: Column) -> Column:
    """|base| ** exponent; a negative base keeps its sign for odd whole exponents and for odd thirds."""
    whole, thirds = F.rint(exponent), F.rint(exponent * 3.0)
    odd = lambda n: (n % 2.0) != 0
    sign = F.when(F.abs(exponent - whole) <= WHOLE, F.when(odd(whole), -1.0).otherwise(1.0)).when((F.abs(exponent - thirds / 3.0) <= WHOLE) & odd(thirds), -1.0).otherwise(1.0)
    size = F.pow(F.abs(base), exponent)
    return F.when(base < 0, sign * size).otherwise(size)


def protected_power_numpy(base: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    whole, thirds = np.rint(exponent), np.rint(np.multiply(exponent, 3.0))
    near = lambda x: np.abs(exponent - x) <= WHOLE
    flips = np.where(near(whole), whole % 2 != 0, near(thirds / 3.0) & (thirds % 2 != 0))
    size = np.power(np.abs(np.asarray(base, float)), exponent)
    return np.where(np.asarray(base) < 0, np.where(flips, -size, size), size)


def nmse_of(r2: Column, floor: float = 1e-15) -> Column:
    """1 - R2, at least ``floor``."""
    return F.greatest(1.0 - F.least(r2, F.lit(1.0)), F.lit(floor))


def strength(r2: Column, most: float = 10.0) -> Column:
    """-log10 of the unexplained part, capped; null and NaN stay."""
    return F.when(F.isnan(r2), r2).otherwise(F.least(-F.log10(nmse_of(r2)), F.lit(most)))


def alphabetic(i: Column) -> Column:
    """0 to a, ..., 25 to z, 26 to aa, ..., 701 to zz."""
    return F.when(i < 26, F.char(97 + i)).otherwise(F.concat(F.char(96 + F.floor(i / 26)), F.char(97 + i % 26)))


def seed64(*parts: Column) -> Column:
    """The first eight bytes of a SHA-256, little-endian, as DECIMAL(20,0)."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    pairs = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in reversed(range(8))))
    return F.conv(pairs, 16, 10).cast("decimal(20,0)")


def id_crc(name: Column) -> Column:
    return F.crc32(name.cast("binary"))


def fit_seed(seed: int, row: Column, dataset: Column) -> Column:
    return F.lit(seed) + row * 1009 + dataset


def masked(x: Column, limit: float = -1e50) -> Column:
    """Null for sentinels at or below ``limit`` and for what isn't finite."""
    return F.when((x > limit) & finite(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clipped(x: Column, lo: float, hi: float, failed: float = 0.0) -> Column:
    """Into [lo, hi]; what isn't finite, and sentinels, as ``failed``."""
    return F.coalesce(F.least(F.greatest(masked(x), F.lit(lo)), F.lit(hi)), F.lit(failed))


def clock(seconds: float) -> str:
    """Seconds as h:mm:ss, on the driver."""
    s = int(seconds)
    return f"{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}"


def duration(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
