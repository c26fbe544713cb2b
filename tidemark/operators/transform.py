"""Differencing, stationarity checks and exact inversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_corr
from tidemark.operators.features import windowed

SEASON = 96
SEASONAL_CORR_MIN = 0.3
SLOPE_RATIO = 0.02


def _flag(v, name: str) -> Column:
    return F.col(name) if v is None else F.lit(bool(v))


def difference(df: DataFrame, seas=None, diff=None, season: int = SEASON, value: str = "y",
               out: str = "y_tr", keys=("series_id",), t: str = "t") -> DataFrame:
    """Seasonal difference then first difference (E1, E2, E6 application).

    ``seas``/``diff`` are booleans for every series, or None to read the
    per-series flag columns ``seas``/``diff`` (from ``choose_transform``).
    Leading rows without a value are NULL; callers drop them.
    """
    s, d = _flag(seas, "seas"), _flag(diff, "diff")

    def make(w):
        y, y1 = F.col(value), F.lag(value, 1).over(w)
        ys, ys1 = y - F.lag(value, season).over(w), y1 - F.lag(value, season + 1).over(w)
        level = F.when(s, ys).otherwise(y)
        prev = F.when(s, ys1).otherwise(y1)
        return [F.when(d, level - prev).otherwise(level).alias(out)]
    return windowed(df, make, season + 1, 0, keys, t)


def seasonal_diff(df: DataFrame, season: int = SEASON, value: str = "y", out: str = "y_seas",
                  keys=("series_id",), t: str = "t") -> DataFrame:
    return difference(df, True, False, season, value, out, keys, t)


def first_diff(df: DataFrame, value: str = "y", out: str = "y_diff", keys=("series_id",), t: str = "t") -> DataFrame:
    return difference(df, False, True, SEASON, value, out, keys, t)


def autocorr(df: DataFrame, lag: int = SEASON, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """Pearson correlation of y_t and y_{t-lag} per series (E3); NULL when undefined."""
    lagged = windowed(df.select(*keys, t, value), lambda w: [F.lag(value, lag).over(w).alias("_lagged")], lag, 0, keys, t)
    return lagged.groupBy(*keys).agg(safe_corr(F.col(value), F.col("_lagged")).alias("autocorr"))


def trend_slope_test(df: DataFrame, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """abs(OLS slope on t) > 0.02 (std_pop + 1e-6) per series (E5)."""
    slope = F.regr_slope(F.col(value), F.col(t).cast("double"))
    return df.groupBy(*keys).agg(
        slope.alias("slope"),
        F.stddev_pop(value).alias("std"),
    ).withColumn(
        "trending", F.coalesce(F.abs("slope") > F.lit(SLOPE_RATIO) * (F.col("std") + F.lit(1e-6)), F.lit(False))
    )


def seasonal_flags(df: DataFrame, season: int = SEASON, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """seas = season > 1 and autocorr(season) > 0.3 (NULL counts as not seasonal)."""
    ac = autocorr(df, season, value, keys, t)
    return ac.withColumn("seas", F.lit(season > 1) & F.coalesce(F.col("autocorr") > SEASONAL_CORR_MIN, F.lit(False)))


def invert_forecasts(pred: DataFrame, series: DataFrame, seas=None, diff=None, season: int = SEASON,
                     steps: int = 3, keys=("series_id",), t: str = "t", value: str = "y",
                     p: str = "y_pred", out: str = "y_pred_orig", flags: DataFrame | None = None) -> DataFrame:
    """Map transformed-domain forecasts back to levels, in closed form.

    pred: (keys, t, step, p) forecasts of y_tr[t+step] made at origin t.
    level_h = prev + sum_{j<=h} p_j with diff (prev = y_t - y_{t-S} when
    seasonal and t >= S, else y_t), else p_h; seasonal adds y_{t+h-S} when
    t+h-S >= 0.  ``flags`` (keys, seas, diff) gives per-series choices.
    """
    keys = list(keys)

    def make(w):
        cols = [F.lag(value, season).over(w).alias("_y_s")]
        cols.append(F.array(*[F.lag(value, season - h).over(w) for h in range(1, steps + 1)]).alias("_bases"))
        return cols
    anchors = windowed(series.select(*keys, t, value), make, season, 0, keys, t).withColumnRenamed(value, "_y")
    joined = pred.join(anchors, on=[*keys, t], how="inner")
    if flags is not None:
        joined = joined.join(flags.select(*keys, "seas", "diff"), on=keys, how="inner")
    s, d = _flag(seas, "seas"), _flag(diff, "diff")
    wcum = Window.partitionBy(*keys, t).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    prev = F.when(s & F.col("_y_s").isNotNull(), F.col("_y") - F.col("_y_s")).otherwise(F.col("_y"))
    level = F.when(d, prev + F.sum(p).over(wcum)).otherwise(F.col(p))
    base = F.get(F.col("_bases"), (F.col("step") - 1).cast("int"))
    value_out = F.when(s & base.isNotNull(), base + level).otherwise(level)
    cols = [c for c in pred.columns]
    return joined.select(*cols, value_out.alias(out))


def original_truth(df: DataFrame, steps: int = 3, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """Long truths (keys, t, step, y_true = y_{t+step}); rows past the end excluded."""
    wide = windowed(df.select(*keys, t, value),
                    lambda w: [F.array(*[F.lead(value, h).over(w) for h in range(1, steps + 1)]).alias("_leads")],
                    0, steps, keys, t)
    long = wide.select(*keys, t, F.posexplode("_leads").alias("_pos", "y_true"))
    return long.where(F.col("y_true").isNotNull()).select(*keys, t, (F.col("_pos") + 1).cast("long").alias("step"), "y_true")
