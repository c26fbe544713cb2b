"""Windowed time-series features.

All row-offset features of one call share a single window over
``(series_id, chunk)`` with halo rows, so Catalyst plans one shuffle and one
sort, and a long series is spread over many tasks.  ``t`` is the contiguous
row index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import slot_of
from tidemark.operators.indexing import chunk_window, with_halo
from tidemark.operators.smoothing import ewm

# fixed values of the feature set
SLOTS_PER_DAY = 96
DAYS_PER_WEEK = 7
MAX_LAG = 8
ROLL_WINDOWS = (3, 6, 12)
DIFF_ORDERS = (1, 2)
EWM_SPANS = {"short": 3, "long": 7}


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def windowed(df: DataFrame, make, before: int, after: int = 0, keys=("series_id",), t: str = "t") -> DataFrame:
    """Run ``make(window) -> list[Column]`` over chunk+halo partitions and keep home rows."""
    keys = _keys(keys)
    framed = with_halo(df, before, after, t)
    w = chunk_window(keys, t)
    cols = make(w)
    return framed.select(*df.columns, *cols, "_home").where("_home").drop("_home")


def lags(df: DataFrame, max_lag: int = MAX_LAG, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """value_lag_k = value_{t-k}, k = 1..max_lag."""
    return windowed(df, lambda w: [F.lag(value, k).over(w).alias(f"{value}_lag_{k}") for k in range(1, max_lag + 1)],
                    max_lag, 0, keys, t)


def multistep_targets(df: DataFrame, steps: int = 3, value: str = "y", keys=("series_id",), t: str = "t",
                      drop_incomplete: bool = True) -> DataFrame:
    """value_step_h = value_{t+h}, h = 1..steps; rows without all targets dropped."""
    out = windowed(df, lambda w: [F.lead(value, h).over(w).alias(f"{value}_step_{h}") for h in range(1, steps + 1)],
                   0, steps, keys, t)
    return out.na.drop(subset=[f"{value}_step_{h}" for h in range(1, steps + 1)]) if drop_incomplete else out


def _roll(value: str, w, size: int, fn) -> Column:
    frame = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(value).over(frame) == size, fn(value).over(frame))


def rolling(df: DataFrame, windows=ROLL_WINDOWS, value: str = "y", keys=("series_id",), t: str = "t",
            stats=("mean", "std")) -> DataFrame:
    """Trailing rolling mean / sample std, NULL until the window is full."""
    def make(w):
        cols = []
        for size in windows:
            if "mean" in stats:
                cols.append(_roll(value, w, size, F.avg).alias(f"{value}_roll_mean_{size}"))
            if "std" in stats:
                cols.append(_roll(value, w, size, F.stddev_samp).alias(f"{value}_roll_std_{size}"))
        return cols
    return windowed(df, make, max(windows) - 1, 0, keys, t)


def diffs(df: DataFrame, orders=DIFF_ORDERS, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """value_diff_k = value_t - value_{t-k} (a k-step difference, not k-th order)."""
    return windowed(df, lambda w: [(F.col(value) - F.lag(value, k).over(w)).alias(f"{value}_diff_{k}") for k in orders],
                    max(orders), 0, keys, t)


def slot_in_day(df: DataFrame, ts: str | None = None, per_day: int = SLOTS_PER_DAY, t: str = "t",
                out: str = "slot_in_day") -> DataFrame:
    """15-minute slot of the day from a timestamp, else row index modulo per_day."""
    if ts is not None:
        slot = F.pmod(slot_of(F.col(ts)), F.lit(per_day))
    else:
        slot = F.pmod(F.col(t), F.lit(per_day))
    return df.withColumn(out, slot.cast("long"))


def daily_cycle(df: DataFrame, per_day: int = SLOTS_PER_DAY, slot: str = "slot_in_day") -> DataFrame:
    """sin/cos of the daily phase."""
    phase = F.lit(2 * math.pi) * F.col(slot) / F.lit(per_day)
    return df.withColumn("sin_d", F.sin(phase)).withColumn("cos_d", F.cos(phase))


def weekly_cycle(df: DataFrame, per_day: int = SLOTS_PER_DAY, t: str = "t") -> DataFrame:
    """sin/cos of the weekly phase, always from the row index."""
    phase = F.lit(2 * math.pi) * F.col(t) / F.lit(per_day * DAYS_PER_WEEK)
    return df.withColumn("sin_w", F.sin(phase)).withColumn("cos_w", F.cos(phase))


def sequence_windows(df: DataFrame, feature_cols, look_back: int = 30, steps: int = 3, target: str = "sum",
                     keys=("series_id",), t: str = "t") -> DataFrame:
    """Look-back windows of feature rows and the following targets.

    Sample at row t holds feature rows t-L+1..t (``x`` as an array of row
    arrays) and targets t+1..t+H; only complete samples are kept, giving
    n-L-H+1 samples per series.  Sample index i = t - L + 1.
    """
    keys = _keys(keys)

    def make(w):
        row = F.array(*[F.col(c).cast("double") for c in feature_cols])
        return [
            F.collect_list(row).over(w.rowsBetween(-(look_back - 1), 0)).alias("x"),
            F.array(*[F.lead(target, h).over(w) for h in range(1, steps + 1)]).alias("y_seq"),
        ]
    out = windowed(df.select(*keys, t, *feature_cols, *([target] if target not in feature_cols else [])),
                   make, look_back - 1, steps, keys, t)
    out = out.where((F.size("x") == look_back) & F.forall("y_seq", lambda v: v.isNotNull()))
    return out.select(*keys, (F.col(t) - (look_back - 1)).alias("sample"), t, "x", "y_seq")


def ar_design(df: DataFrame, p: int = 8, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """Rows (x_{t-1}..x_{t-p}) -> x_t for t >= p; empty when n <= p (C11)."""
    out = lags(df.select(*_keys(keys), t, value), p, value, keys, t)
    return out.where(F.col(t) >= p)


def build_features(df: DataFrame, value: str = "y", ts: str | None = None, keys=("series_id",), t: str = "t",
                   max_len: int | None = None) -> DataFrame:
    """Calendar, lag, rolling, difference and EWM features of the booster.

    The offset features are computed in one window stage; the two EWMs are
    chunked scans.
    """
    keys = _keys(keys)
    before = max(MAX_LAG, max(ROLL_WINDOWS) - 1, max(DIFF_ORDERS))

    def make(w):
        cols = [F.lag(value, k).over(w).alias(f"{value}_lag_{k}") for k in range(1, MAX_LAG + 1)]
        for size in ROLL_WINDOWS:
            cols.append(_roll(value, w, size, F.avg).alias(f"{value}_roll_mean_{size}"))
            cols.append(_roll(value, w, size, F.stddev_samp).alias(f"{value}_roll_std_{size}"))
        cols += [(F.col(value) - F.lag(value, k).over(w)).alias(f"{value}_diff_{k}") for k in DIFF_ORDERS]
        return cols

    out = windowed(df, make, before, 0, keys, t)
    out = slot_in_day(out, ts, t=t)
    out = daily_cycle(out)
    out = weekly_cycle(out, t=t)
    for name, span in EWM_SPANS.items():
        out = ewm(out, span, value, f"{value}_ewm_{name}", keys, t, max_len=max_len)
    return out


def feature_columns(value: str = "y") -> dict[str, list[str]]:
    """Names produced by build_features, grouped (the FeatureSpec of the design)."""
    lag_cols = [f"{value}_lag_{k}" for k in range(1, MAX_LAG + 1)]
    roll = [f"{value}_roll_{s}_{w}" for w in ROLL_WINDOWS for s in ("mean", "std")]
    base = ["slot_in_day", "sin_d", "cos_d", "sin_w", "cos_w"] + roll + \
        [f"{value}_diff_{k}" for k in DIFF_ORDERS] + [f"{value}_ewm_{n}" for n in EWM_SPANS]
    return {"lags": lag_cols, "base": base}
