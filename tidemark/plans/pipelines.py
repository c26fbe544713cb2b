"""The reference's four end-to-end flows as lazy Spark compositions (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import decompose as dc
from tidemark.operators import features as fe
from tidemark.operators import metrics as me
from tidemark.operators import models as mo
from tidemark.operators import quality as qa
from tidemark.operators import search as se
from tidemark.operators import splits as sp
from tidemark.operators import transform as tr
from tidemark.sources.series import components_to_wide, row_sum_target


def trend_decomposition(series: DataFrame, alphas, trials: int = dc.DEFAULT_TRIALS, seed: int = 42, max_modes: int | None = None) -> dict:
    """L1: alpha search (smoothing x decomposition x forecastability score),
    then the final trend decomposition at each series' winning (alpha, epsilon)."""
    from tidemark.operators.smoothing import detrend, zero_phase_trend
    from tidemark.session import cut_lineage

    scores = cut_lineage(se.alpha_search(series, alphas, qa.forecastability_score, trials=trials, seed=seed,
                                         max_modes=max_modes))
    best = scores.select("series_id", "best_alpha", "best_epsilon", "best_score").distinct()
    s = series.select("series_id", "t", "y").join(best.select("series_id", F.col("best_alpha").alias("alpha")), on="series_id")
    trend = detrend(zero_phase_trend(s, F.col("alpha"), alpha_hi=max(alphas)), out="_sr")
    trend = cut_lineage(trend)
    cands = best.select("series_id", F.lit(0).cast("long").alias("cand_id"), F.col("best_epsilon").alias("epsilon"),
                        F.lit(seed).cast("long").alias("seed"))
    dec = dc.ensemble_decompose(trend.select("series_id", "t", F.col("_sr").alias("y")), cands, trials=trials,
                                max_modes=max_modes)
    return {"scores": scores, "best": best, "trend": trend.select("series_id", "t", "y", "trend", F.col("_sr").alias("residual")),
            "decomposition": dec}


def direct_decomposition(series: DataFrame, trials: int = dc.DEFAULT_TRIALS, seed: int = 42, min_len: int = 100) -> dict:
    """L2: epsilon search, decomposition at the chosen epsilon, quality tables, status."""
    from tidemark.session import cut_lineage

    chosen = cut_lineage(se.epsilon_search(series, qa.predictive_quality, trials=trials, seed=seed))
    cands = chosen.select("series_id", F.lit(0).cast("long").alias("cand_id"), "epsilon", F.lit(seed).cast("long").alias("seed"))
    dec = cut_lineage(dc.ensemble_decompose(series, cands, trials=trials, min_len=min_len))
    comps = dc.components_of(dec).drop("cand_id")
    return {
        "epsilon": chosen,
        "components": comps,
        "energy": qa.energy_distribution(comps, series),
        "quality": qa.quality_report(comps, series, chosen.select("series_id", "epsilon"), optimized=True),
        "status": dc.batch_status(dec, series),
        "summary": dc.batch_summary(dec, series),
    }


BOOSTER_TARGET = "y_tr"


def booster_features(series: DataFrame, flags: DataFrame | None = None, seas=None, diff=None, steps: int = 3,
                     extra=None):
    """Features from the original series (documented choice), targets from the
    transformed one; rows with any missing feature or target dropped; 60/20/20
    split.  Every other numeric column of ``series`` (e.g. decomposition
    components) is a feature too, unless ``extra`` names them.  Returns
    (table, feature column names)."""
    cols = fe.feature_columns("y")
    if extra is None:
        extra = [c for c, dt in series.dtypes if c not in ("series_id", "t", "ts", "y")
                 and dt in ("double", "float", "int", "bigint")]
    feats = fe.build_features(series.select("series_id", "t", "y", *extra))
    src = series.select("series_id", "t", "y")
    if flags is not None:
        src = src.join(flags.select("series_id", "seas", "diff"), on="series_id")
    ytr = tr.difference(src, seas, diff, out=BOOSTER_TARGET).select("series_id", "t", BOOSTER_TARGET)
    tg = fe.multistep_targets(ytr, steps, BOOSTER_TARGET, drop_incomplete=False)
    table = feats.join(tg, on=["series_id", "t"])
    features = ["y", *extra, *cols["base"], *cols["lags"]]
    table = table.na.drop(subset=[*features, BOOSTER_TARGET, *[f"{BOOSTER_TARGET}_step_{h}" for h in range(1, steps + 1)]])
    return sp.temporal_split(table), features


def feature_subset(features, lags, value: str = "y") -> list[str]:
    """The features without the lags that were not chosen."""
    chosen = {f"{value}_lag_{k}" for k in lags}
    return [f for f in features if not f.startswith(f"{value}_lag_") or f in chosen]


def pooled_lags(train: DataFrame, val: DataFrame, steps: int = 3) -> list[int]:
    """The lag set with the smallest mean weighted F24 over the series: one model
    serves all of them (H7)."""
    scores = se.lag_subset_search(train, val, steps=steps, target=BOOSTER_TARGET)
    best = scores.groupBy("cand_id", "lags").agg(F.avg("weighted_f24").alias("score")).orderBy(
        F.asc_nulls_last("score"), "cand_id").first()
    return [int(k) for k in best["lags"].split(",")]


def trend_forecast(series: DataFrame, learning_rate: float = 0.1, n_trees: int = 50, seed: int = 42,
                   use_transform: bool = True, steps: int = 3, lag_search: bool = True, candidates=None,
                   early_stopping: bool = True, joint: bool = False) -> dict:
    """L3: features -> per-series transform choice -> targets -> split -> lag set
    search -> booster search over ``candidates`` ((learning rate, trees) pairs,
    none: the given values) -> boosters per step (or ``joint``) that stop on the
    validation rows, cut from the search's own fits -> metrics in both domains,
    with the weighted F24 of each split.
    """
    from tidemark.session import cut_lineage

    flags = cut_lineage(bt.choose_transform(series)) if use_transform else None
    seas = None if use_transform else False
    diff = None if use_transform else False
    table, features = booster_features(series, flags, seas, diff, steps)
    table = cut_lineage(table)
    train = table.where(F.col("split") == "train")
    val = table.where(F.col("split") == "val")
    lags = pooled_lags(train, val, steps) if lag_search else None
    if lags is not None:
        features = feature_subset(features, lags)
    history = None
    if candidates:
        history, fitted = mo.search_boosters(train, val, features, candidates, steps, BOOSTER_TARGET, seed, joint)
        history = cut_lineage(history)
        best = history.orderBy(F.asc_nulls_last("weighted_f24"), "iteration").first()
        models = [m.first(int(best["n_trees"])) for m in fitted[best["learning_rate"]]]
        fit = {"models": [m.stopped() if early_stopping else m for m in models], "status": [m.status for m in models]}
    else:
        fit = mo.fit_boosted_multistep(train, features, steps, BOOSTER_TARGET, learning_rate, n_trees, seed, val=val,
                                       early_stopping=early_stopping, joint=joint)
    summary = mo.evaluate_splits(fit["models"], table, series.select("series_id", "t", "y"), features, steps,
                                 BOOSTER_TARGET, flags=flags, seas=seas, diff=diff)
    return {"lags": lags, "history": history, "table": table, "features": features, "models": fit["models"], "status": fit["status"], "summary": summary,
            "flags": flags}


def sequence_forecast(components: DataFrame, look_back: int = 30, steps: int = 3, fit_on: str = "train") -> dict:
    """L4: component columns -> row-sum target -> min-max scaling -> look-back
    windows -> 80/20 holdout -> per-step linear models -> weighted RMSE in
    the original scale."""
    from tidemark.session import cut_lineage

    wide = cut_lineage(components_to_wide(components))
    comp_cols = [c for c in wide.columns if c not in ("series_id", "t")]
    wide = row_sum_target(wide, comp_cols, "sum")
    samples0 = fe.sequence_windows(wide, comp_cols, look_back, steps, "sum")
    split = sp.holdout_split(samples0.select("series_id", "t")).withColumnRenamed("split", "split")
    marks = wide.join(split, on=["series_id", "t"], how="left").withColumn(
        "split", F.coalesce(F.col("split"), F.lit("train")))
    bounds = cut_lineage(sp.minmax_fit(marks, [*comp_cols, "sum"], split_col="split", fit_on=fit_on))
    scaled = sp.minmax_scale(marks, [*comp_cols, "sum"], bounds=bounds)
    sc_cols = [f"{c}_sc" for c in comp_cols]
    # the windows feed one fit per step and the scoring: materialise once
    samples = cut_lineage(fe.sequence_windows(scaled, sc_cols, look_back, steps, "sum_sc").join(split, on=["series_id", "t"]))
    train = samples.where(F.col("split") == "train")
    test = samples.where(F.col("split") == "test")
    models = mo.fit_sequence_regressor(train, steps)
    pred = mo.predict_sequence(models, test)
    back = sp.minmax_inverse(pred, bounds, {"y_pred": "sum", "y_true": "sum"})
    back = back.select("series_id", "t", "step", F.col("y_true_inv").alias("y_true"), F.col("y_pred_inv").alias("y_pred"))
    m = me.forecast_metrics(back, ["series_id", "step"])
    return {"predictions": back, "metrics": m, "weighted_rmse": me.weighted_rmse(m, ["series_id"]), "models": models}
