"""Gram-based operators against direct NumPy computations; noise and decomposition invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import laplace_noise, laplace_noise_np, xxhash64_longs_np
from tidemark.operators import backtest as bt
from tidemark.operators import decompose as dc
from tidemark.operators import search as se


def _series(spark, named):
    rows = [(sid, t, float(v)) for sid, x in named.items() for t, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "t", "y"]), "series_id string, t long, y double")


def direct_mase(x, p=8, H=1, min_train=128, step=8):
    """Expanding-window AR errors: one design matrix of sliding windows, and the
    H-step forecasts as powers of the companion matrix."""
    windows = np.lib.stride_tricks.sliding_window_view(x, p)[:, ::-1]
    design = np.column_stack([np.ones(len(windows)), windows])  # row k: 1, x[k+p-1], ..., x[k]
    missed = []
    for origin in range(min_train, len(x) - H, step):
        fitted, *_ = np.linalg.lstsq(design[:origin - p], x[p:origin], rcond=None)
        companion = np.zeros((p + 1, p + 1))
        companion[0, 0] = 1
        companion[1] = fitted
        companion[np.arange(2, p + 1), np.arange(1, p)] = 1
        state = design[origin - p]
        for h in range(H):
            state = companion @ state
            missed.append(abs(x[origin + h] - state[1]))
    return np.mean(missed) / np.mean(np.abs(np.diff(x)))


def test_backtest_equals_refit_loop(spark, small_chunks):
    rng = np.random.default_rng(0)
    n = 300
    named = {"noise": rng.normal(size=n), "walk": np.cumsum(rng.normal(size=n)) + 100,
             "sine": 10 * np.sin(np.arange(n) * 2 * np.pi / 24) + 0.1 * rng.normal(size=n) + 1000,
             "short": rng.normal(size=100)}
    out = bt.rolling_ar_backtest(_series(spark, named), horizons=(1, 4)).collect()
    got = {(r.series_id, r.horizon): r.mase for r in out}
    for sid in ("noise", "walk", "sine"):
        for h in (1, 4):
            assert got[(sid, h)] == pytest.approx(direct_mase(named[sid], H=h), rel=1e-7)
    assert got[("short", 1)] == 1.0


def test_adf_decisions(spark):
    rng = np.random.default_rng(1)
    named = {"walk": np.cumsum(rng.normal(size=400)), "noise": rng.normal(size=400)}
    res = {r.series_id: r for r in bt.adf_test(_series(spark, named)).collect()}
    assert res["walk"].need_diff and not res["noise"].need_diff
    assert res["noise"].p_value < 0.01
    assert bt.mackinnon_p(-2.8614) == pytest.approx(0.05, abs=2e-3)


def test_noise_twin_is_bit_identical(spark):
    df = spark.range(0, 500).select(F.col("id").alias("t")).select(
        "t", F.xxhash64(F.lit(7).cast("long"), F.lit(2).cast("long"), F.col("t")).alias("h"),
        laplace_noise(F.lit(7), F.lit(2), F.col("t")).alias("w")).orderBy("t").toPandas()
    assert (xxhash64_longs_np(7, 2, np.arange(500)).astype(np.int64) == df["h"].to_numpy()).all()
    np.testing.assert_allclose(laplace_noise_np(7, 2, np.arange(500)), df["w"].to_numpy(), rtol=0, atol=1e-15)


def test_decomposition_reconstructs_and_is_partition_independent(spark):
    t = np.arange(300)
    x = np.sin(2 * np.pi * t / 10) + 0.5 * np.sin(2 * np.pi * t / 60) + 0.01 * t
    df = _series(spark, {"a": x})
    out = dc.ensemble_decompose(df, trials=5, epsilon=0.2).toPandas()
    w = out.pivot_table(index="t", columns="component", values="value")
    np.testing.assert_allclose(w.sum(axis=1).to_numpy(), x, atol=1e-9)
    again = dc.ensemble_decompose(df.repartition(3), trials=5, epsilon=0.2).toPandas()
    a = out.sort_values(["component", "t"])["value"].to_numpy()
    b = again.sort_values(["component", "t"])["value"].to_numpy()
    np.testing.assert_allclose(a, b)


def test_decomposition_status_for_short_series(spark):
    df = _series(spark, {"tiny": [1.0, 2.0]})
    st = dc.batch_status(dc.ensemble_decompose(df, trials=2), df).first()
    assert st.status == "Error" and "fewer" in st.error_message


def test_batch_summary_scores_each_series(spark):
    rng = np.random.default_rng(8)
    wave = {k: np.sin(np.arange(150) / (3 + k)) + rng.normal(0, 0.2, 150) for k in range(2)}
    df = _series(spark, {"tiny": [1.0, 2.0], **{f"s{k}": x.tolist() for k, x in wave.items()}})
    dec = dc.ensemble_decompose(df, trials=2)
    got = {r["series_id"]: r for r in dc.batch_summary(dec, df).collect()}
    parts = dc.components_of(dec).toPandas()
    assert set(got) == {"tiny", "s0", "s1"}
    assert got["tiny"]["strategy"] == "N/A" and got["tiny"]["orthogonality_index"] is None
    for k, x in wave.items():
        row, mine = got[f"s{k}"], parts[parts["series_id"] == f"s{k}"]
        table = mine.pivot(index="t", columns="component", values="value").to_numpy()
        modes = mine[mine["component"] != "residual"].pivot(index="t", columns="component", values="value").to_numpy()
        cross = sum((modes[:, i] * modes[:, j]).sum() for i in range(modes.shape[1]) for j in range(i))
        assert row["orthogonality_index"] == pytest.approx(2 * abs(cross) / (modes ** 2).sum(), rel=1e-9)
        assert row["rrmse"] == pytest.approx(np.sqrt(((x - table.sum(1)) ** 2).mean()) / x.std(), abs=1e-9)
        assert row["signal_energy"] == pytest.approx((x ** 2).sum(), rel=1e-9)
        assert row["strategy"] == "predictive" and row["num_imfs"] == modes.shape[1]
        assert row["predictive_quality"] is not None


def test_lag_subset_rule_fixture(spark):
    df = spark.createDataFrame([([0.9] * 7,), ([0.1, 0.9, 0.1, 0.1, 0.1, 0.1, 0.6],)], "flags array<double>")
    got = [r[0] for r in df.select(se.lag_subset(F.col("flags"))).collect()]
    assert got == [[1, 2, 3, 4, 5, 6], [1, 3, 8]]
    assert len(se.legal_subsets()) == 120


def test_lag_subset_search_equals_per_subset_refits(spark):
    """All 120 candidates: one-Gram scoring equals a direct fit per subset."""
    from tidemark.operators import features as fe
    from tidemark.operators import splits as sp

    rng = np.random.default_rng(3)
    n = 260
    named = {"ar": np.convolve(rng.normal(size=n + 5), [1, 0.6, 0.3, 0.1], "valid")[:n] + 50,
             "sine": 5 * np.sin(np.arange(n) * 2 * np.pi / 12) + rng.normal(size=n) + 30}
    df = _series(spark, named)
    feats = sp.temporal_split(fe.multistep_targets(fe.lags(df, 8), 3).na.drop())
    got = se.lag_subset_search(feats.where("split = 'train'"), feats.where("split = 'val'")).toPandas()
    pdf = feats.toPandas()
    weights = np.array([5.0, 3.0, 2.0])
    for sid in named:
        part = pdf[pdf.series_id == sid]
        tr, va = part[part.split == "train"], part[part.split == "val"]
        for ci, sub in enumerate(se.legal_subsets()):
            cols = [f"y_lag_{k}" for k in sub]
            # standardised lags, free intercept, penalty 1e-8 per row as extra rows
            mu, sd = tr[cols].to_numpy().mean(0), tr[cols].to_numpy().std(0)
            xt = np.c_[np.ones(len(tr)), (tr[cols].to_numpy() - mu) / sd]
            xv = np.c_[np.ones(len(va)), (va[cols].to_numpy() - mu) / sd]
            pen = np.sqrt(1e-8 * len(tr)) * np.c_[np.zeros(len(sub)), np.eye(len(sub))]
            f24s = []
            for h in (1, 2, 3):
                yt, yv = tr[f"y_step_{h}"].to_numpy(), va[f"y_step_{h}"].to_numpy()
                beta = np.linalg.lstsq(np.r_[xt, pen], np.r_[yt, np.zeros(len(sub))], rcond=None)[0]
                e = xv @ beta - yv
                f24s.append((np.mean(e ** 2) + np.mean(np.abs(e)) + np.mean(np.abs(e) / (np.abs(yv) + 1e-10))) / 3)
            want = float(weights @ np.array(f24s) / weights.sum())
            row = got[(got.series_id == sid) & (got.cand_id == ci)]
            assert row["lags"].iloc[0] == ",".join(map(str, sub))
            assert row["weighted_f24"].iloc[0] == pytest.approx(want, rel=1e-6)
        best = got[(got.series_id == sid) & got.best]
        assert len(best) == 1
        assert best["weighted_f24"].iloc[0] == pytest.approx(got[got.series_id == sid]["weighted_f24"].min())


def test_status_counts(spark):
    df = _series(spark, {"ok": np.sin(np.arange(60) / 3.0), "tiny": [1.0, 2.0]})
    st = dc.batch_status(dc.ensemble_decompose(df, trials=2, max_modes=3), df)
    counts = {r.status: r.n_series for r in dc.status_counts(st).collect()}
    assert counts == {"Success": 1, "Error": 1}


def test_subset_fits_shift_with_the_series():
    """Adding a constant to y shifts every fitted forecast by that constant."""
    rng = np.random.default_rng(11)
    y = np.cumsum(rng.normal(size=400)) * 0.1 + rng.normal(size=400)
    subsets, forecasts = se.legal_subsets(), []
    for shift in (0.0, 1000.0):
        z = y + shift
        x = np.stack([np.ones(380), *[z[10 - k:390 - k] for k in range(1, 9)]], 1)
        target = np.stack([z[10 + h:390 + h] for h in (1, 2, 3)], 1)
        full = np.c_[x, target]
        coef = se.fit_subsets(full.T @ full, subsets, 8, 3, 1e-8)
        forecasts.append(np.einsum("nj,khj->nkh", x, coef))
    np.testing.assert_allclose(forecasts[1] - 1000.0, forecasts[0], atol=1e-4)


def test_subset_fit_of_a_constant_series():
    full = np.full((50, 12), 3.0)
    full[:, 0] = 1
    coef = se.fit_subsets(full.T @ full, se.legal_subsets(), 8, 3, 1e-8)
    np.testing.assert_allclose(coef.sum(2) - coef[:, :, 0], 0, atol=1e-9)
    np.testing.assert_allclose(coef[:, :, 0], 3.0)


def test_best_round_waits():
    from tidemark.operators.models import best_round

    assert best_round([5, 6, 4, 4.5, 3, 9]) == 5
    assert best_round([5.0, *[6.0] * 50, 1.0]) == 1
    assert best_round([5.0, *[6.0] * 48, 1.0]) == 50


def test_early_stopping_keeps_the_best_trees(spark):
    from tidemark.operators import models as mo

    rng = np.random.default_rng(2)
    x = rng.normal(size=600)
    pdf = pd.DataFrame({"series_id": "a", "t": np.arange(600), "x": x, "y_tr_step_1": np.sin(2 * x) + rng.normal(size=600)})
    train, val = spark.createDataFrame(pdf[:400]), spark.createDataFrame(pdf[400:])
    fit = mo.fit_boosted_multistep(train, ["x"], 1, learning_rate=0.3, n_trees=30, val=val, early_stopping=True)
    whole = mo.fit_boosted_multistep(train, ["x"], 1, learning_rate=0.3, n_trees=30)["models"][0]
    losses = []
    for k in range(1, 31):
        pred = mo.predict_multistep([whole.first(k)], val).toPandas().sort_values("t")["y_pred"].to_numpy()
        losses.append(((pred - pdf["y_tr_step_1"].to_numpy()[400:]) ** 2).mean())
    assert len(fit["models"][0].trees) == int(np.argmin(losses)) + 1
    assert fit["status"] == ["ok"]


def dense_natural_spline(xk, yk, xs):
    """Natural cubic spline by a dense solve for the second derivatives."""
    n, h = len(xk), np.diff(xk)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((yk[i + 1] - yk[i]) / h[i] - (yk[i] - yk[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    j = np.clip(np.searchsorted(xk, xs, "right") - 1, 0, n - 2)
    u = (xs - xk[j]) / h[j]
    bend = ((1 - u) ** 3 - (1 - u)) * m[j] + (u ** 3 - u) * m[j + 1]
    return (1 - u) * yk[j] + u * yk[j + 1] + h[j] ** 2 / 6 * bend


def test_envelopes_are_natural_splines():
    from tidemark.operators import emd

    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(6, 80)), axis=1) + rng.normal(size=(6, 80))
    x[1, 10:20] = x[1, 10]  # a plateau
    for marks in emd.turning_points(x):
        got = emd.envelopes(x, marks)
        for r in range(len(x)):
            i = np.flatnonzero(marks[r])
            xk = np.r_[0, i, 79].astype(float)
            yk = np.r_[x[r, i[0]], x[r, i], x[r, i[-1]]]
            np.testing.assert_allclose(got[r], dense_natural_spline(xk, yk, np.arange(80.0)), atol=1e-9)


def test_decomposition_separates_two_tones(spark):
    t = np.arange(600)
    fast, slow = np.sin(2 * np.pi * t / 8), 0.7 * np.sin(2 * np.pi * t / 90 + 1)
    out = dc.ensemble_decompose(_series(spark, {"a": fast + slow}), trials=16, epsilon=0.02).toPandas()
    w = out[out.component != "residual"].pivot_table(index="t", columns="k", values="value").to_numpy()
    inner = slice(60, 540)
    for tone in (fast, slow):
        assert max(np.corrcoef(w[inner, k], tone[inner])[0, 1] for k in range(w.shape[1])) > 0.95


def test_decomposition_tasks_follow_the_trials(spark):
    df = _series(spark, {"a": np.sin(np.arange(200) / 3.0)})
    lengths = df.select(F.lit(1).cast("long").alias("seed"), F.lit(200).cast("long").alias("n")).distinct()
    blocks = {r["first"]: r["count"] for r in dc._noise_table(lengths, 100).where("k = 0").collect()}
    assert len(blocks) == 8 and sum(blocks.values()) == 100
    long = df.select(F.lit(1).cast("long").alias("seed"), F.lit(dc.BLOCK_POINTS // 2).cast("long").alias("n")).distinct()
    plan = dc._noise_table(long, 6)
    assert plan.columns == ["seed", "n", "first", "k", "count", "w"]


def test_long_series_is_decomposed(spark):
    t = np.arange(30000)
    x = np.sin(2 * np.pi * t / 50) + t / 10000
    out = dc.ensemble_decompose(_series(spark, {"a": x}), trials=2, epsilon=0.02, max_modes=2)
    back = out.groupBy("t").agg(F.sum("value").alias("v")).orderBy("t").toPandas()["v"].to_numpy()
    np.testing.assert_allclose(back, x, atol=1e-9)


def test_cyclic_reduction_equals_a_dense_solve():
    from tidemark.operators.emd import solve_dominant

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 50, 257):
        low, high = rng.uniform(0, 3, n), rng.uniform(0, 3, n)
        low[0] = high[-1] = 0
        if n > 40:
            low[20] = high[19] = 0  # two systems in a row
        diagonal = 2 * (low + high) + 1e-3
        a = np.diag(diagonal) + np.diag(low[1:], -1) + np.diag(high[:-1], 1)
        right = rng.normal(size=n)
        np.testing.assert_allclose(solve_dominant(low, diagonal, high, right), np.linalg.solve(a, right), rtol=1e-9, atol=1e-9)


def test_flat_beginnings_and_plateaus_count_once():
    from tidemark.operators.emd import turning_points

    maxima, minima = turning_points(np.array([[1.0, 1, 0, 0, 2, 2, 2, 1], [0, 0, 1, 1, 1, 0, 0, 0], [3, 3, 3, 3, 3, 3, 3, 3]]))
    assert [np.flatnonzero(r).tolist() for r in maxima] == [[1, 6], [4], []]
    assert [np.flatnonzero(r).tolist() for r in minima] == [[3], [1], []]


def test_components_of_one_group_score_as_when_spread_over_chunks(spark, monkeypatch):
    """One pass over a component gives the backtest errors and periods of the chunked operators."""
    from tidemark.operators import backtest as bt
    from tidemark.operators import quality as qa

    rng = np.random.default_rng(3)
    made = {("a", "IMF_1"): rng.normal(size=300).cumsum(), ("a", "residual"): np.sin(np.arange(137)), ("b", "IMF_1"): rng.normal(size=3),
            ("b", "residual"): rng.normal(size=139), ("c", "IMF_1"): np.zeros(150), ("c", "residual"): rng.normal(size=136)}
    long = spark.createDataFrame([(s, c, t, float(v)) for (s, c), x in made.items() for t, v in enumerate(x)],
                                 "series_id string, component string, t long, y double")
    ck = ["series_id", "component"]
    spread = bt.rolling_ar_backtest(long, ck, "y", "t", horizons=(1, 4)).join(qa.main_period(long, "y", ck), on=ck)
    want = {(r.series_id, r.component, r.horizon): (r.mase, r.main_period) for r in spread.collect()}
    calls = []
    monkeypatch.setattr(bt, "rolling_ar_backtest", lambda *a, **k: calls.append(a))
    got = {(r.series_id, r.component, r.horizon): (r.mase, r.main_period) for r in qa._periods_and_errors(long, ck, (1, 4), "t").collect()}
    assert not calls and got.keys() == want.keys() and len(got) == 12
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6), k


def test_uneven_components_are_spread(spark, monkeypatch):
    from tidemark.operators import backtest as bt
    from tidemark.operators import quality as qa

    monkeypatch.setattr(bt, "rolling_ar_backtest", lambda *a, **k: (_ for _ in ()).throw(InterruptedError))
    for ts, y in (([0, 1, 1, 3], 1.0), ([1, 2, 3, 4], 1.0), ([0, 1, 2, 3], None), ([0, 1, 2, 3], float("nan"))):
        rows = spark.createDataFrame([("a", "IMF_1", t, y if t == 3 else 1.0) for t in ts],
                                     "series_id string, component string, t long, y double")
        with pytest.raises(InterruptedError):
            qa._periods_and_errors(rows, ["series_id", "component"], (1, 4), "t")


def test_noise_is_shared_by_candidates_after_the_shuffle(spark, monkeypatch):
    """Sending the noise to the candidates moves no copy of it; the modes stay the same."""
    from tidemark.operators import decompose as dc

    series = spark.createDataFrame([("s", t, float(np.sin(t / 3) + np.cos(t / 17))) for t in range(120)],
                                   "series_id string, t long, y double")
    cands = spark.createDataFrame([("s", k, 0.1 * (k + 1), 42 + 1000 * (k % 2)) for k in range(4)],
                                  "series_id string, cand_id long, epsilon double, seed long")
    made = []
    for limit in (0, dc.BROADCAST_BYTES):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
        made.append(dc.ensemble_decompose(series, cands, trials=16).orderBy("cand_id", "k", "t").collect())
    assert made[0] == made[1] and len(made[0]) > 960 and {r.status for r in made[0]} == {"Success"}


def test_mean_envelope_is_the_mean_of_both_envelopes():
    """One system for both splines gives the same bits; knots close together and far apart."""
    from tidemark.operators import emd

    rng = np.random.default_rng(8)
    t = np.arange(400)
    for x in (rng.normal(size=(5, 400)), np.sin(t / 9.0) + np.arange(5)[:, None] * np.sin(t / 31.0), rng.integers(0, 3, (5, 400))):
        x = x.astype(float)
        maxima, minima = emd.turning_points(x)
        both = emd.envelopes(np.concatenate([x, x]), np.concatenate([maxima, minima]))
        extrema = maxima | minima
        got = emd.mean_envelope(x, np.flatnonzero(extrema), extrema.sum(1))
        assert np.array_equal(got, (both[:5] + both[5:]) * 0.5)


def test_short_series_decompose_in_one_task_as_stage_by_stage(spark, monkeypatch):
    t = np.arange(120)
    df = _series(spark, {"a": np.sin(t / 3.0) + t / 50, "b": np.cos(t / 5.0) * t, "flat": np.ones(120), "short": np.ones(3)})
    cands = df.select("series_id", F.posexplode(F.array(F.lit(0.1), F.lit(0.4))).alias("cand_id", "epsilon")).distinct() \
        .withColumn("seed", F.lit(7) + F.col("cand_id"))

    def rows(most):
        out = dc.ensemble_decompose(df, cands, trials=5, max_modes=most)
        return sorted(map(tuple, out.collect()), key=lambda r: str(r[:2]) + str(r[6]) + str(r[4]).zfill(9))

    monkeypatch.setattr(dc, "_stage", lambda *a: 1 / 0)
    whole = {most: rows(most) for most in (None, 2)}
    monkeypatch.undo()
    monkeypatch.setattr(dc, "BLOCK_POINTS", 200)  # one trial a block, as without the limit
    for most, want in whole.items():
        assert rows(most) == want
    assert {r[8] for r in want if r[0] == "short"} == {"Error"} and {r[5] for r in want if r[0] == "flat"} == {"residual"}


def test_scores_of_whole_decompositions_are_those_of_their_components(spark):
    from tidemark.operators import quality as qa

    rng = np.random.default_rng(4)
    df = _series(spark, {"a": rng.normal(size=200).cumsum(), "b": np.ones(200), "c": rng.normal(size=20)})
    cands = df.select("series_id").distinct().selectExpr("series_id", "2L as cand_id", "0.3D as epsilon", "5L as seed")
    ck = ["series_id", "cand_id"]
    long = dc.components_of(dc.ensemble_decompose(df, cands, trials=4)).cache()
    signal = df.join(cands, "series_id")
    whole = qa.measure_whole(dc.whole_decompositions(df, cands, trials=4), ck)
    for part in (qa.series_stats, qa.forecastability_score):
        want, got = part(long, signal, ck), part(whole, None, ck)
        got = got.select(want.columns)
        for x, y in zip(got.orderBy(*ck).collect(), want.orderBy(*ck).collect(), strict=True):
            assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], rel=1e-9, abs=1e-12)


def test_forecastability_search_stores_no_components(spark, monkeypatch):
    """Neither the decomposition nor the scoring of short series goes over rows of points, or mode by mode."""
    from tidemark.operators import quality as qa
    from tidemark.operators import search as se

    df = _series(spark, {"a": np.sin(np.arange(150) / 4.0) + np.cos(np.arange(150) / 17.0)})
    args = (df, [0.1, 0.4], qa.forecastability_score)
    small = {"trials": 2, "refine_points": 3, "max_modes": 3, "epsilons": (0.2, 0.4)}
    monkeypatch.setattr(qa.forecastability_score, "measure", None)
    want = sorted(map(tuple, se.alpha_search(*args, **small).collect()))
    monkeypatch.undo()
    for name in ("_stage", "components_of"):
        monkeypatch.setattr(dc, name, lambda *a: 1 / 0)
    got = sorted(map(tuple, se.alpha_search(*args, **small).collect()))
    assert len(got) == 2
    for x, y in zip(got, want, strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], rel=1e-9)
    gap = df.where("t <> 5").withColumn("t", F.when(F.col("t") == 6, 7).otherwise(F.col("t")))  # a time that repeats
    assert dc.whole_decompositions(gap, df.selectExpr("series_id", "0L as cand_id", "0.1D as epsilon", "1L as seed").distinct()) is None
