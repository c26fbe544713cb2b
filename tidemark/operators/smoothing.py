"""Exponential smoothing family (C6, C13-C17), all on the chunked scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import alpha_max, half_life
from tidemark.operators.indexing import series_length
from tidemark.operators.scan import affine_scan, max_group_length

__all__ = [
    "exp_smooth", "double_exp_smooth", "zero_phase_trend", "detrend", "ewm",
    "half_life", "alpha_max", "with_half_life",
]


def _alpha(alpha) -> Column:
    return alpha if isinstance(alpha, Column) else F.lit(float(alpha))


def exp_smooth(df: DataFrame, alpha, value: str = "y", out: str = "s", keys=("series_id",),
               t: str = "t", alpha_hi: float | None = None, max_len: int | None = None) -> DataFrame:
    """s_0 = x_0; s_t = alpha x_t + (1 - alpha) s_{t-1}  (C13).

    ``alpha`` may be a column that is constant per key group (candidate
    alphas); ``alpha_hi`` then bounds it from above.
    """
    a = _alpha(alpha)
    if not isinstance(alpha, Column) and float(alpha) >= 1.0:
        return df.withColumn(out, F.col(value).cast("double"))
    hi = float(alpha) if not isinstance(alpha, Column) else float(alpha_hi if alpha_hi is not None else 1.0)
    b = F.when(F.col(t) == 0, F.col(value)).otherwise(a * F.col(value))
    return affine_scan(df, keys, t, b, 1 - a, out, decay_min=1.0 - hi, max_len=max_len)


def double_exp_smooth(df: DataFrame, alpha, value: str = "y", out: str = "s2", keys=("series_id",),
                      t: str = "t", alpha_hi: float | None = None, max_len: int | None = None) -> DataFrame:
    """Single smoothing applied to the single-smoothed series (C14)."""
    keys = list(keys)
    if max_len is None:
        max_len = max_group_length(df, keys, t)
    first = exp_smooth(df, alpha, value, "_s1", keys, t, alpha_hi, max_len)
    return exp_smooth(first, alpha, "_s1", out, keys, t, alpha_hi, max_len).drop("_s1")


def zero_phase_trend(df: DataFrame, alpha, value: str = "y", out: str = "trend", keys=("series_id",),
                     t: str = "t", alpha_hi: float | None = None) -> DataFrame:
    """Mean of forward and backward double smoothing.

    The backward pass runs the same scan on the reversed index ``n-1-t``; the
    series length comes from one aggregate joined back (no whole-series window).
    """
    keys = list(keys)
    n = series_length(df, keys, t, "_n")
    max_len = max_group_length(df, keys, t)
    staged = df.join(n, on=keys, how="inner").withColumn("_r", F.col("_n") - 1 - F.col(t))
    fwd = double_exp_smooth(staged, alpha, value, "_fwd", keys, t, alpha_hi, max_len)
    both = double_exp_smooth(fwd, alpha, value, "_bwd", keys, "_r", alpha_hi, max_len)
    return both.withColumn(out, (F.col("_fwd") + F.col("_bwd")) / 2).drop("_n", "_r", "_fwd", "_bwd")


def detrend(df: DataFrame, value: str = "y", trend: str = "trend", out: str = "residual") -> DataFrame:
    """residual = y - trend."""
    return df.withColumn(out, F.col(value) - F.col(trend))


def ewm(df: DataFrame, span: float, value: str = "y", out: str | None = None, keys=("series_id",),
        t: str = "t", max_len: int | None = None) -> DataFrame:
    """Bias-adjusted exponentially weighted mean, alpha = 2/(span+1).

    sum_i (1-a)^i y_{t-i} / sum_i (1-a)^i: the numerator is a scan with unit
    gain, the denominator has the closed form (1 - (1-a)^{t+1}) / a.
    """
    a = 2.0 / (span + 1.0)
    out = out or f"ewm_{int(span) if float(span).is_integer() else span}"
    num = affine_scan(df, keys, t, F.col(value), 1.0 - a, "_ewm_num", max_len=max_len)
    return num.withColumn(
        out, F.col("_ewm_num") * F.lit(a) / (1 - F.pow(F.lit(1.0 - a), F.col(t) + 1))
    ).drop("_ewm_num")


def with_half_life(df: DataFrame, alpha: str = "alpha", out: str = "half_life") -> DataFrame:
    """Half life of a smoothing factor column (C17)."""
    return df.withColumn(out, half_life(F.col(alpha)))
