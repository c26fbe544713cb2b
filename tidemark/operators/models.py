"""Distributed training and scoring.

Histogram boosters (``operators.boosting``) per forecast step or for all steps
jointly, trained on the pooled feature rows of all series, and linear models on
look-back windows.  Predictions come back as the long ``predictions`` table and
are scored with the grouped metrics.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as me
from tidemark.operators.boosting import PATIENCE, Booster, BoostParams, Fit, best_round, fit_boosters, predict_boosters
from tidemark.operators.search import LR_BOUNDS, TREE_BOUNDS

FALLBACK = {"rate": 0.1, "trees": 100}  # fixed values of the second attempt
MAX_FITS = 4  # linear fits and stability runs at the same time


def _targets(target: str, steps: int) -> list[str]:
    return [f"{target}_step_{h}" for h in range(1, steps + 1)]


def _groups(steps: int, joint: bool) -> list[list[int]]:
    """Outputs of each model: all steps together, or one model per step."""
    return [list(range(steps))] if joint else [[h] for h in range(steps)]


def _params(learning_rate: float, n_trees: int, seed: int) -> tuple[BoostParams, str]:
    """The wanted parameters, or the fallback's with a status that names the reason."""
    try:
        params = BoostParams(float(learning_rate), int(n_trees), int(seed))
        params.check()
        return params, "ok"
    except (ValueError, TypeError) as exc:
        return BoostParams(seed=int(seed), **FALLBACK), f"fallback: {type(exc).__name__}"


def fit_boosted_multistep(train: DataFrame, features, steps: int = 3, target: str = "y_tr", learning_rate: float = 0.1,
                          n_trees: int = 100, seed: int = 42, val: DataFrame | None = None,
                          early_stopping: bool = False, joint: bool = False) -> dict:
    """Squared-error boosters, one per step or one for all steps with vectors in
    its leaves (``joint``) (R1); with ``early_stopping`` rounds end after
    PATIENCE without a better validation loss and the trees up to the best stay
    (R2); parameters that are rejected are replaced by 100 trees at lr 0.1 (R3).

    Returns {"models": [booster...], "status": [...]}."""
    params, status = _params(learning_rate, n_trees, seed)
    stop = early_stopping and val is not None
    fits = [Fit(outputs, params) for outputs in _groups(steps, joint)]
    models = fit_boosters(train, val if stop else None, features, _targets(target, steps), fits, PATIENCE if stop else None)
    for m in models:
        m.status = status
    return {"models": [m.stopped() if stop else m for m in models], "status": [status] * len(models)}


def predict_multistep(models: list[Booster], df: DataFrame, features=None, keys=("series_id", "t"), extra=()) -> DataFrame:
    """Long predictions (keys, extra, step, y_pred) of every model."""
    return predict_boosters(models, df, keys, extra).drop("model", "trees")


def evaluate_splits(models, feats: DataFrame, series: DataFrame, features, steps: int = 3, target: str = "y_tr",
                    flags: DataFrame | None = None, seas=None, diff=None, season: int = 96,
                    weights=me.F24_WEIGHTS) -> DataFrame:
    """Metrics per (split, domain, step) in the transformed and the original
    domain (R6).  Original-domain forecasts are the exact inversion of the
    transformed ones; truths are y_{t+h} of the untruncated series."""
    from tidemark.operators.transform import invert_forecasts, original_truth

    pred = predict_multistep(models, feats, features, extra=["split"])
    truth_tr = feats.select("series_id", "t", F.posexplode(F.array(*[F.col(f"{target}_step_{h}") for h in range(1, steps + 1)]))
                            .alias("_i", "y_true")).select("series_id", "t", (F.col("_i") + 1).cast("long").alias("step"), "y_true")
    trans = pred.join(truth_tr, on=["series_id", "t", "step"]).withColumn("domain", F.lit("transformed"))
    lv = invert_forecasts(pred, series, seas, diff, season, steps, flags=flags)
    orig = lv.join(original_truth(series, steps), on=["series_id", "t", "step"]).select(
        "series_id", "t", "split", "step", "y_true", F.col("y_pred_orig").alias("y_pred")).withColumn("domain", F.lit("original"))
    both = trans.select("series_id", "t", "split", "step", "y_true", "y_pred", "domain").unionByName(orig)
    m = me.forecast_metrics(both, ["split", "domain", "step"])
    return me.performance_summary(m, keys=(), weights=weights)


def feature_importance(models: list[Booster], features=None) -> list:
    """Every feature's importance per step.

    Importances are a property of the fitted models (a few numbers per
    feature), read on the driver; a joint model has the same for all its steps."""
    return [(f, float(v), h) for m in models for h in m.steps for f, v in zip(m.features, m.importance)]


def importance_frame(spark, models, features=None, top: int | None = None) -> DataFrame:
    """(feature, importance, step, rank) sorted; the mean across steps has step
    NULL; ``top``: only the most important of each step and of the mean (M13)."""
    from pyspark.sql import Window

    per_step = spark.createDataFrame(feature_importance(models), "feature string, importance double, step long")
    mean = per_step.groupBy("feature").agg(F.avg("importance").alias("importance")).withColumn("step", F.lit(None).cast("long"))
    w = Window.partitionBy("step").orderBy(F.desc("importance"), "feature")
    out = per_step.unionByName(mean).withColumn("rank", F.row_number().over(w))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.orderBy(F.col("step").asc_nulls_last(), "rank")


def search_boosters(train: DataFrame, val: DataFrame, features, candidates, steps: int = 3, target: str = "y_tr",
                    seed: int = 42, joint: bool = False) -> tuple[DataFrame, dict]:
    """Score (learning_rate, n_trees) candidates by validation weighted F24 (H8).

    All learning rates (and steps) are fitted side by side, each once and to its
    largest tree count; a candidate is scored by the first trees of its fit, all
    of them in one pass over the validation rows.  Returns the search history
    (iteration, learning_rate, n_trees, weighted_f24, best_so_far) and the fitted
    models by learning rate, with their validation losses."""
    spark = train.sparkSession
    for lr, nt in candidates:
        if not (LR_BOUNDS[0] <= lr <= LR_BOUNDS[1] and TREE_BOUNDS[0] <= nt <= TREE_BOUNDS[1]):
            raise ValueError(f"candidate ({lr}, {nt}) outside {LR_BOUNDS} x {TREE_BOUNDS}")
    rates = list(dict.fromkeys(lr for lr, _ in candidates))
    most = {lr: max(int(nt) for rate, nt in candidates if rate == lr) for lr in rates}
    groups = _groups(steps, joint)
    fits = [Fit(outputs, BoostParams(lr, most[lr], seed)) for lr in rates for outputs in groups]
    models = fit_boosters(train, val, features, _targets(target, steps), fits)
    fitted = {lr: models[k * len(groups):(k + 1) * len(groups)] for k, lr in enumerate(rates)}

    counts = [sorted({int(nt) for rate, nt in candidates if rate == fit.params.rate}) for fit in fits]
    pred = predict_boosters(models, val, counts=counts)
    truth = val.select("series_id", "t", F.posexplode(F.array(*[F.col(c) for c in _targets(target, steps)]))
                       .alias("_i", "y_true")).select("series_id", "t", (F.col("_i") + 1).cast("long").alias("step"), "y_true")
    pred = pred.withColumn("rate_no", F.floor(F.col("model") / len(groups)))
    m = me.forecast_metrics(pred.join(truth, on=["series_id", "t", "step"]), ["rate_no", "trees", "step"])
    scores = {(rates[r["rate_no"]], r["trees"]): float(r["weighted_f24"])
              for r in me.weighted_f24(m, ["rate_no", "trees"]).collect()}
    rows = [(i, float(lr), int(nt), scores.get((lr, int(nt)))) for i, (lr, nt) in enumerate(candidates, start=1)]
    hist = spark.createDataFrame(rows, "iteration long, learning_rate double, n_trees long, weighted_f24 double")
    hist = me.convergence_curve(hist.withColumn("_all", F.lit(1)), ["_all"], "iteration", "weighted_f24").join(
        hist, on="iteration").drop("_all")
    return hist, fitted


def booster_search(train: DataFrame, val: DataFrame, features, candidates, steps: int = 3, target: str = "y_tr",
                   seed: int = 42, joint: bool = False) -> DataFrame:
    """The history of ``search_boosters`` (H8)."""
    return search_boosters(train, val, features, candidates, steps, target, seed, joint)[0]


def fit_sequence_regressor(samples: DataFrame, steps: int = 3, reg: float = 1e-3, elastic: float = 0.0,
                           max_iter: int = 50) -> list:
    """One linear model per step on flattened look-back windows.

    ``samples`` from ``sequence_windows`` (x: array of rows, y_seq: targets)."""
    data = samples.withColumn("features", array_to_vector(F.flatten("x")))
    models = []
    for h in range(steps):
        lr = LinearRegression(featuresCol="features", labelCol="_label", regParam=reg, elasticNetParam=elastic,
                              maxIter=max_iter)
        models.append(lr.fit(data.withColumn("_label", F.col("y_seq")[h])))
    return models


def predict_sequence(models, samples: DataFrame) -> DataFrame:
    data = samples.withColumn("features", array_to_vector(F.flatten("x")))
    out = None
    for h, model in enumerate(models, start=1):
        p = model.transform(data).select("series_id", "t", F.lit(h).cast("long").alias("step"),
                                         F.col("y_seq")[h - 1].alias("y_true"), F.col("prediction").alias("y_pred"),
                                         *[c for c in ("split",) if c in samples.columns])
        out = p if out is None else out.unionByName(p)
    return out


def stability_runs(train: DataFrame, test: DataFrame, fit_fn, predict_fn, seeds, weights=me.RMSE_WEIGHTS) -> DataFrame:
    """Refit with every seed, weighted RMSE of each run on the test rows.

    Returns (run, seed, weighted_rmse); feed to run_stats / best_run."""
    spark = train.sparkSession

    def one(item):
        run, seed = item
        models = fit_fn(train, seed)
        pred = predict_fn(models, test).withColumn("_all", F.lit(1))
        m = me.forecast_metrics(pred, ["_all", "step"])
        return (run, int(seed), float(me.weighted_rmse(m, ["_all"], weights).first()["weighted_rmse"]))

    # independent refits: their jobs run concurrently
    with ThreadPoolExecutor(max_workers=min(MAX_FITS, max(1, len(seeds)))) as pool:
        rows = list(pool.map(one, list(enumerate(seeds))))
    return spark.createDataFrame(rows, "run long, seed long, weighted_rmse double")


__all__ = ["best_round", "booster_search", "evaluate_splits", "feature_importance", "fit_boosted_multistep",
           "fit_sequence_regressor", "importance_frame", "predict_multistep", "predict_sequence", "search_boosters",
           "stability_runs", "vector_to_array"]
