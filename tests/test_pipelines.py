"""The end-to-end flows run on the smallest driver tables and return sane tables."""

from pyspark.sql import functions as F

from tidemark.plans import pipelines as pl
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_direct_decomposition_flow(spark):
    g = fx.events_grid(spark, SF).select("series_id", "t", "y")
    out = pl.direct_decomposition(g, trials=3, min_len=100)
    status = out["status"].collect()
    assert status and all(r.status == "Success" for r in status)
    q = out["quality"].where(F.col("metric") == "Optimized Epsilon").collect()
    assert len(q) == len(status) and all(0.05 <= float(r.value) <= 1.0 for r in q)
    energy = out["energy"].toPandas()
    for sid, grp in energy.groupby("series_id"):
        total = grp[grp.component == "Total"]["energy"].iloc[0]
        parts = grp[grp.component != "Total"]["energy"].sum()
        assert abs(total - parts) <= 1e-9 * max(1.0, abs(parts))


def test_trend_decomposition_flow(spark):
    g = fx.events_grid(spark, SF).select("series_id", "t", "y")
    out = pl.trend_decomposition(g, [0.1, 0.4], trials=3, max_modes=4)
    best = out["best"].collect()
    assert {r.best_alpha for r in best} <= {0.1, 0.4}
    scores = out["scores"].toPandas()
    for sid, grp in scores.groupby("series_id"):
        assert grp["score"].min() == grp["best_score"].iloc[0]
    dec = out["decomposition"].where("status = 'Success'")
    recon = dec.groupBy("series_id", "t").agg(F.sum("value").alias("s")).join(
        out["trend"].select("series_id", "t", "residual"), on=["series_id", "t"])
    assert recon.where(F.abs(F.col("s") - F.col("residual")) > 1e-8).count() == 0


def test_booster_features_take_component_columns(spark):
    from tidemark.sources.series import components_to_wide

    wide = components_to_wide(fx.events_components(spark, SF)).withColumn(
        "y", F.col("IMF_1") + F.col("IMF_2") + F.col("residual"))
    table, features = pl.booster_features(wide, seas=False, diff=True)
    assert {"IMF_1", "IMF_2", "residual", "y", "y_lag_8"} <= set(features)
    assert table.where(F.col("y_tr_step_3").isNull()).count() == 0


def test_score_strategies(spark):
    from tidemark.operators import quality as qa

    comps = fx.events_components(spark, SF)
    g = fx.events_grid(spark, SF).select("series_id", "t", "y")
    oi = {r.series_id: r.score for r in qa.score_by_strategy(comps, g, "other").collect()}
    ref = {r.series_id: r.orthogonality_index for r in qa.orthogonality_index(comps, g).collect()}
    assert oi == ref
    bal = qa.score_by_strategy(comps, g, "balanced").columns
    assert bal[-1] == "score"


def test_booster_beats_persistence_on_seasonal_ar(spark):
    import numpy as np
    import pandas as pd

    from tidemark.operators import metrics as me
    from tidemark.operators import models as mo

    rng = np.random.default_rng(42)
    n = 1500
    e = rng.normal(size=n)
    x = np.zeros(n)
    for i in range(2, n):
        x[i] = 0.6 * x[i - 1] - 0.2 * x[i - 2] + e[i]
    y = x + 8 * np.sin(2 * np.pi * np.arange(n) / 24) + 100
    pdf = pd.DataFrame({"series_id": "s", "t": np.arange(n), "y": y})
    series = spark.createDataFrame(pdf, "series_id string, t long, y double")
    table, features = pl.booster_features(series, seas=False, diff=False)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    models = mo.fit_boosted_multistep(train, features, 3, "y_tr", 0.1, 60, seed=7)["models"]
    pred = mo.predict_multistep(models, test, features)
    truth = test.select("series_id", "t", F.posexplode(F.array("y_tr_step_1", "y_tr_step_2", "y_tr_step_3"))
                        .alias("i", "y_true")).select("series_id", "t", (F.col("i") + 1).cast("long").alias("step"), "y_true")
    model_rmse = me.forecast_metrics(pred.join(truth, on=["series_id", "t", "step"]), ["step"]).orderBy("step").collect()
    naive = test.select(F.posexplode(F.array("y_tr_step_1", "y_tr_step_2", "y_tr_step_3")).alias("i", "y_true"),
                        F.col("y").alias("y_pred")).withColumn("step", F.col("i") + 1)
    naive_rmse = me.forecast_metrics(naive, ["step"]).orderBy("step").collect()
    for m, b in zip(model_rmse, naive_rmse):
        assert m.rmse < b.rmse


def test_feature_subset_keeps_base_features():
    names = ["y", "slot_in_day", "y_lag_1", "y_lag_2", "y_lag_8", "y_diff_1"]
    assert pl.feature_subset(names, [1, 8]) == ["y", "slot_in_day", "y_lag_1", "y_lag_8", "y_diff_1"]


def test_alpha_search_refines_the_epsilon_of_every_alpha(spark, monkeypatch):
    """Every alpha gets the best of the refined grid; its score is the first run's."""
    from tidemark.operators import search as se

    def scores(series, cands, score_fn, trials, max_modes, keys):
        rows = cands.withColumn("s", F.abs(F.col("epsilon") - 0.25 - 0.05 * F.col("alpha_idx")) + 1 + F.col("run"))
        return se.repeat_and_average(rows, [*keys, "epsilon"], "s", [F.min_by("s", "run").alias("first_score")]) \
            .withColumnRenamed("s", "score")

    monkeypatch.setattr(se, "score_epsilons", scores)
    g = spark.range(60).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.sin("id").alias("y"))
    got = sorted(se.alpha_search(g, [0.1, 0.2, 0.9], None, refine_points=31).collect(), key=lambda r: r.alpha)
    assert [round(r.epsilon, 9) for r in got] == [0.25, 0.3, 0.35]
    assert [round(r.score, 9) for r in got] == [1.0, 1.0, 10.0]
    assert {(r.best_alpha, round(r.best_score, 9)) for r in got} <= {(0.1, 1.0), (0.2, 1.0)}


def test_searches_are_registered_whole(spark, monkeypatch):
    from tidemark.operators import search as se
    from tidemark.plans import catalog

    seen = []

    def stages(series, score_fn, keys, grid, runs, refine_points, bounds, min_gain, trials, seed, max_modes,
               grid_runs=None):
        seen.append((trials, grid_runs or runs, runs, refine_points, len(grid), series.select(*keys).distinct().count()))
        raise InterruptedError

    monkeypatch.setattr(se, "_epsilon_stages", stages)
    n = fx.events_grid(spark, SF).select("series_id").distinct().count()
    for name in ("epsilon_grid_search", "alpha_search"):
        try:
            catalog.REGISTRY[name].run(spark, SF)
        except InterruptedError:
            pass
    assert seen == [(100, 2, 2, 25, 5, n), (100, 1, 2, 25, 5, 20 * n)]


def test_booster_candidates_are_the_first_trees_of_one_fit(spark, monkeypatch):
    from tidemark.operators import models as mo

    rows = spark.range(300).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.sin("id").alias("x"),
                                   (F.sin(F.col("id")) * 3 + 10).alias("y_tr_step_1"))
    short = mo.fit_boosted_multistep(rows, ["x"], 1, n_trees=3)["models"][0]
    long = mo.fit_boosted_multistep(rows, ["x"], 1, n_trees=10)["models"][0]
    got, want = ([r.y_pred for r in mo.predict_multistep([m], rows).orderBy("t").collect()] for m in (long.first(3), short))
    assert got == want
    sent = []
    fit = mo.fit_boosters
    monkeypatch.setattr(mo, "fit_boosters", lambda *a, **k: sent.append([(f.params.rate, f.params.trees) for f in a[4]])
                        or fit(*a, **k))
    cands = [(0.1, 10), (0.5, 12), (0.1, 12), (0.5, 10)]
    hist = mo.booster_search(rows, rows, ["x"], cands, 1).orderBy("iteration").collect()
    assert [(r.learning_rate, r.n_trees) for r in hist] == cands and sent == [[(0.1, 12), (0.5, 12)]]
    pred = {r.t: r.y_pred for r in mo.predict_multistep([long], rows).collect()}
    y = {r.t: r.y_tr_step_1 for r in rows.collect()}
    errors = [y[t] - p for t, p in pred.items()]
    rmse = (sum(e * e for e in errors) / 300)
    f24 = (rmse + sum(map(abs, errors)) / 300 + sum(abs(e) / (abs(y[t]) + 1e-10) for (t, _), e in zip(pred.items(), errors)) / 300) / 3
    assert hist[0].weighted_f24 != hist[2].weighted_f24 and abs(hist[0].weighted_f24 - 5 * f24 / 10) < 1e-9  # step 1 weighs 5 of 10


def test_joint_models_and_fallback(spark):
    from tidemark.operators import models as mo

    rows = spark.range(400).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.sin("id").alias("x"),
                                   *[(F.sin(F.col("id") + h) * 3 + 10).alias(f"y_tr_step_{h}") for h in (1, 2, 3)])
    fit = mo.fit_boosted_multistep(rows, ["x"], 3, n_trees=8, joint=True)
    assert len(fit["models"]) == 1 and fit["status"] == ["ok"]
    pred = mo.predict_multistep(fit["models"], rows)
    assert pred.count() == 1200 and {r.step for r in pred.select("step").distinct().collect()} == {1, 2, 3}
    imp = mo.importance_frame(spark, fit["models"], top=1).collect()
    assert [(r.feature, r.step, r["rank"]) for r in imp] == [("x", 1, 1), ("x", 2, 1), ("x", 3, 1), ("x", None, 1)]
    bad = mo.fit_boosted_multistep(rows, ["x"], 1, learning_rate=-1, n_trees=5)
    assert bad["status"] == ["fallback: ValueError"] and len(bad["models"][0].trees) == 100
    assert bad["models"][0].params.rate == 0.1 and bad["models"][0].status == "fallback: ValueError"


def test_the_search_keeps_its_models(spark):
    out = pl.trend_forecast(fx.events_seasonal(spark, SF), use_transform=False, lag_search=False,
                            candidates=[(0.3, 10), (0.3, 40), (0.05, 10)])
    hist = out["history"].orderBy("iteration").collect()
    best = min(hist, key=lambda r: r.weighted_f24)
    assert all(m.params.rate == best.learning_rate and len(m.trees) <= best.n_trees == len(m.losses) or
               len(m.trees) == len(m.losses) <= best.n_trees for m in out["models"])
    assert out["status"] == ["ok"] * 3 and out["summary"].where("split = 'test'").count() > 0


def test_registered_boosters_search_rates_and_trees(spark, monkeypatch):
    from tidemark.operators import models as mo
    from tidemark.plans import catalog

    seen = []

    def search(train, val, features, candidates, *rest, **more):
        seen.append(candidates)
        raise InterruptedError

    monkeypatch.setattr(mo, "search_boosters", search)
    monkeypatch.setattr(pl, "pooled_lags", lambda *a: [1])
    for name in ("booster_search", "fit_boosted_multistep", "evaluate_splits", "feature_importance"):
        try:
            catalog.REGISTRY[name].run(spark, SF)
        except InterruptedError:
            pass
    assert len(seen) == 4
    for candidates in seen:
        assert {t for _, t in candidates} >= {10, 500, 2000} and len({r for r, _ in candidates}) >= 4
    assert catalog.MODEL_TREES == 500
