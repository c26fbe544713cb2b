"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "safe_corr",
    "band_weight",
    "half_life",
    "alpha_max",
    "hash_uniform",
    "laplace_noise",
    "normal_noise",
    "slot_of",
    "laplace_noise_np",
    "xxhash64_longs_np",
]

TWO_POW_53 = float(1 << 53)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate that is NULL (not an error) on constants.

    ``corr`` raises under ANSI mode when a side is constant; the regression
    sums also skip pairs with a NULL side, like ``corr``.
    """
    return F.try_divide(
        F.regr_sxy(b, a), F.sqrt(F.regr_sxx(b, a) * F.regr_syy(b, a))
    )


def band_weight(period: Column, horizon) -> Column:
    """Frequency-band relevance of a component period for horizon H."""
    h = F.lit(horizon) if not isinstance(horizon, Column) else horizon
    return (
        F.when(period < 1.5 * h, F.lit(0.25))
        .when(period <= 8 * h, F.lit(1.0))
        .otherwise(F.lit(0.5))
    )


def half_life(alpha: Column) -> Column:
    """Half life in steps of an exponential smoother; infinite for alpha >= 0.999."""
    return F.when(alpha >= 0.999, F.lit(float("inf"))).otherwise(
        -F.lit(math.log(2.0)) / F.log(1 - alpha)
    )


def alpha_max(h_min: float) -> float:
    """Largest smoothing factor whose half life is at least ``h_min`` steps."""
    return 1.0 - 2.0 ** (-1.0 / h_min)


def hash_uniform(*cols: Column) -> Column:
    """Uniform in the open interval (-1/2, 1/2), reproducible from the key columns.

    Uses the top 53 bits of a 64-bit hash; the result never reaches +-1/2, so
    logarithms downstream stay finite.  Independent of partitioning.
    """
    h = F.xxhash64(*cols)
    top = F.shiftrightunsigned(h, 11).cast("double")
    return (top + 0.5) / TWO_POW_53 - 0.5


def laplace_noise(*cols: Column) -> Column:
    """Zero-mean Laplace draw with unit standard deviation (scale 1/sqrt 2).

    Keys are hashed as 64-bit integers (see ``laplace_noise_np`` for the same
    draw inside Arrow tasks)."""
    u = hash_uniform(*[c.cast("long") for c in cols])
    b = 1.0 / math.sqrt(2.0)
    return -b * F.signum(u) * F.log(1 - 2 * F.abs(u))


def normal_noise(*cols: Column) -> Column:
    """Standard normal draw by Box-Muller on two independent hash uniforms."""
    u1 = hash_uniform(*cols, F.lit("u1")) + 0.5
    u2 = hash_uniform(*cols, F.lit("u2")) + 0.5
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def slot_of(ts: Column, minutes: int = 15) -> Column:
    """Integer bucket number since the epoch (``minutes`` wide) of a timestamp.

    Exact floor division on the integer microsecond count (no float rounding at
    bucket borders).
    """
    width = minutes * 60 * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("long")


# ---------------------------------------------------------------- the same draws in NumPy
# fixed values: the 64-bit xxHash primes and Spark's default hash seed
XXH_P1 = 0x9E3779B185EBCA87
XXH_P2 = 0xC2B2AE3D27D4EB4F
XXH_P3 = 0x165667B19E3779F9
XXH_P4 = 0x85EBCA77C2B2AE63
XXH_P5 = 0x27D4EB2F165667C5
SPARK_HASH_SEED = 42


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs_np(*values) -> "np.ndarray":
    """NumPy twin of Spark ``xxhash64`` over BIGINT arguments (broadcasting)."""
    with np.errstate(over="ignore"):
        h = np.uint64(SPARK_HASH_SEED)
        for v in values:
            v = np.asarray(v, dtype=np.int64).astype(np.uint64)
            acc = h + np.uint64(XXH_P5) + np.uint64(8)
            acc = acc ^ (_rotl(v * np.uint64(XXH_P2), 31) * np.uint64(XXH_P1))
            acc = _rotl(acc, 27) * np.uint64(XXH_P1) + np.uint64(XXH_P4)
            acc = acc ^ (acc >> np.uint64(33))
            acc = acc * np.uint64(XXH_P2)
            acc = acc ^ (acc >> np.uint64(29))
            acc = acc * np.uint64(XXH_P3)
            h = acc ^ (acc >> np.uint64(32))
        return h


def laplace_noise_np(*values) -> "np.ndarray":
    """Same draws as ``laplace_noise`` for integer keys, computed inside a task."""
    h = xxhash64_longs_np(*values)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / TWO_POW_53 - 0.5
    return -(1.0 / math.sqrt(2.0)) * np.sign(u) * np.log(1 - 2 * np.abs(u))
