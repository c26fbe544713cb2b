"""Forecast-error aggregates and result tables.

Inputs are long: one row per (keys..., step, y_true, y_pred); every metric is
one grouped aggregation with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: step weights of the two pipelines
F24_WEIGHTS = (5.0, 3.0, 2.0)
RMSE_WEIGHTS = (0.5, 0.3, 0.2)
MAPE_EPS = 1e-8
F24_EPS = 1e-10


def _e(y_true: str, y_pred: str) -> Column:
    return F.col(y_pred) - F.col(y_true)


def rmse(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.sqrt(F.avg(F.pow(_e(y_true, y_pred), 2)))


def mae(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.avg(F.abs(_e(y_true, y_pred)))


def r2(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """1 - SSE/SST; SST = 0 gives 1 for a perfect fit, else 0."""
    sse = F.sum(F.pow(_e(y_true, y_pred), 2))
    sst = F.count(y_true) * F.var_pop(y_true)
    return F.when(sst > 0, 1 - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def mape(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """100 * mean |e / (y + 1e-8)| (signed denominator, as specified)."""
    return F.avg(F.abs(_e(y_true, y_pred) / (F.col(y_true) + F.lit(MAPE_EPS)))) * 100


def f24(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """(mean e^2 + mean |e| + mean |e|/(|y|+1e-10)) / 3."""
    e = _e(y_true, y_pred)
    return (F.avg(F.pow(e, 2)) + F.avg(F.abs(e)) + F.avg(F.abs(e) / (F.abs(F.col(y_true)) + F.lit(F24_EPS)))) / 3


def forecast_metrics(df: DataFrame, keys, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """n, rmse, mae, r2, mape, f24 per group (M1-M5)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        rmse(y_true, y_pred).alias("rmse"),
        mae(y_true, y_pred).alias("mae"),
        r2(y_true, y_pred).alias("r2"),
        mape(y_true, y_pred).alias("mape"),
        f24(y_true, y_pred).alias("f24"),
    )


def weights_frame(spark: SparkSession, weights=F24_WEIGHTS) -> DataFrame:
    """(step, weight) rows; a literal table of len(weights) rows."""
    return spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(weights)], "step long, weight double")


def weighted_f24(metrics: DataFrame, keys, weights=F24_WEIGHTS, score: str = "f24") -> DataFrame:
    """sum_h w_h f24_h / sum(w) over all weights; RMSE stands in for a missing F24;
    steps beyond the weights are ignored (M6)."""
    wf = weights_frame(metrics.sparkSession, weights)
    total = float(sum(weights))
    j = metrics.join(F.broadcast(wf), on="step", how="inner")
    s = F.coalesce(F.col(score), F.col("rmse")) if "rmse" in metrics.columns else F.col(score)
    return j.groupBy(*keys).agg((F.sum(F.col("weight") * s) / F.lit(total)).alias("weighted_f24"))


def weighted_rmse(metrics: DataFrame, keys, weights=RMSE_WEIGHTS) -> DataFrame:
    """sum_h w_h rmse_h (M7)."""
    wf = weights_frame(metrics.sparkSession, weights)
    j = metrics.join(F.broadcast(wf), on="step", how="inner")
    return j.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("rmse")).alias("weighted_rmse"))


def mase(pred: DataFrame, series: DataFrame, keys=("series_id",), by=(), y_true: str = "y_true",
         y_pred: str = "y_pred", value: str = "y", t: str = "t", naive_scope: str = "all",
         train_end: DataFrame | None = None) -> DataFrame:
    """mean |e| / mean |diff(y)| per series (and ``by`` groups) (M8).

    Empty forecasts -> 1.0; a series of <= 1 row -> 1.0; zero naive error ->
    1e-10.  The naive error uses the whole series by default (the scored
    definition), or only rows before ``train_end`` (keys, t_end) with
    naive_scope="train".
    """
    from tidemark.operators.features import windowed

    keys, by = list(keys), list(by)
    d = windowed(series.select(*keys, t, value), lambda w: [(F.col(value) - F.lag(value, 1).over(w)).alias("_d")],
                 1, 0, keys, t)
    if naive_scope == "train" and train_end is not None:
        d = d.join(train_end, on=keys).where(F.col(t) < F.col("t_end"))
    naive = d.groupBy(*keys).agg(F.avg(F.abs("_d")).alias("_naive"), F.count("_d").alias("_nd"))
    err = pred.groupBy(*keys, *by).agg(F.avg(F.abs(F.col(y_true) - F.col(y_pred))).alias("_fe"))
    j = err.join(naive, on=keys, how="left")
    nz = F.when(F.col("_naive") == 0, F.lit(1e-10)).otherwise(F.col("_naive"))
    m = F.when(F.col("_fe").isNull() | F.coalesce(F.col("_nd") < 1, F.lit(True)), F.lit(1.0)).otherwise(F.col("_fe") / nz)
    return j.select(*keys, *by, m.alias("mase"))


def forecast_errors(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", suffix: str = "") -> DataFrame:
    """error = pred - true, abs_error, pct_error = 100 (pred - true)/(true + 1e-8)."""
    e = F.col(y_pred) - F.col(y_true)
    return df.select(
        "*",
        e.alias(f"error{suffix}"),
        F.abs(e).alias(f"abs_error{suffix}"),
        (F.lit(100.0) * e / (F.col(y_true) + F.lit(MAPE_EPS))).alias(f"pct_error{suffix}"),
    )


def abs_error_nullsafe(a: str, b: str) -> Column:
    """NULL when either side is missing, else |a - b|."""
    return F.abs(F.col(a) - F.col(b))


# columns of the long predictions and what they are called in the wide table
WIDE_NAMES = {"y_true": "true", "y_pred": "pred", "y_true_orig": "true_orig", "y_pred_orig": "pred_orig"}


def prediction_table(pred_long: DataFrame, keys=("series_id", "t"), features: DataFrame | None = None,
                     feature_cols=(), max_features: int | None = None, steps=None, literals=None) -> DataFrame:
    """Wide per-row report: truths and predictions per step, features, literals.

    Pairs in the original domain (``y_true_orig``, ``y_pred_orig``) and tables
    without truths are taken as they come.  ``steps``: the step numbers (read
    from the data by a small job when not given); ``max_features``: keep only
    the first so many; ``literals``: {name: value} columns such as run metadata."""
    keys = list(keys)
    if steps is None:
        steps = [r[0] for r in pred_long.select("step").distinct().orderBy("step").collect()]
    wide = pred_long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("step") == s, F.col(c))).alias(f"{name}_step_{s}")
        for s in steps for c, name in WIDE_NAMES.items() if c in pred_long.columns])
    if features is not None and feature_cols:
        wide = wide.join(features.select(*keys, *list(feature_cols)[:max_features]), on=keys, how="left")
    return wide.select("*", *[F.lit(v).alias(k) for k, v in (literals or {}).items()])


def performance_summary(metrics: DataFrame, keys=("series_id",), weights=F24_WEIGHTS) -> DataFrame:
    """One row per (keys, domain, step) with its weight and the metrics (M9)."""
    wf = weights_frame(metrics.sparkSession, weights)
    return metrics.join(F.broadcast(wf), on="step", how="left")


def run_stats(runs: DataFrame, keys, score: str) -> DataFrame:
    """mean, population std, min, max, median of a score over repeated runs."""
    return runs.groupBy(*keys).agg(
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.median(score).alias("median"),
        F.count(F.lit(1)).cast("long").alias("n_runs"),
    )


def best_run(runs: DataFrame, keys, score: str, run: str = "run") -> DataFrame:
    """The run with the smallest score (ties: smallest run id)."""
    return runs.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(score), F.col(run)), F.struct(F.col(score), F.col(run))).alias("_b")
    ).select(*keys, F.col(f"_b.{run}").alias(f"best_{run}"), F.col(f"_b.{score}").alias(f"best_{score}"))


def convergence_curve(history: DataFrame, keys, iteration: str = "iteration", score: str = "score") -> DataFrame:
    """Running best score by iteration (M12).  Search histories are small per key."""
    w = Window.partitionBy(*keys).orderBy(iteration).rowsBetween(Window.unboundedPreceding, 0)
    return history.select(*keys, iteration, F.min(score).over(w).alias(f"best_{score}"))


def data_info(df: DataFrame, keys, split: str = "split") -> DataFrame:
    """Row counts per split."""
    return df.groupBy(*keys, split).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def data_info_summary(df: DataFrame, keys, n_features: int, steps: int, lags: DataFrame | None = None,
                      split: str = "split") -> DataFrame:
    """One row per series: rows per split, number of features, forecast steps
    and the selected lags (M14)."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        *[F.count(F.when(F.col(split) == s, 1)).cast("long").alias(f"n_{s}") for s in ("train", "val", "test")])
    out = counts.withColumn("n_features", F.lit(n_features).cast("long")).withColumn("steps", F.lit(steps).cast("long"))
    if lags is not None:
        out = out.join(lags.select(*keys, "lags"), on=keys, how="left")
    return out
