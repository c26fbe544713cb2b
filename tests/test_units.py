"""Hand-made fixtures (FIXTURES section 4) and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import metrics as me
from tidemark.operators import quality as qa
from tidemark.operators import smoothing as sm
from tidemark.operators import transform as tr
from tidemark.operators.scan import affine_scan


def series_df(spark, values, sid="a"):
    pdf = pd.DataFrame({"series_id": sid, "t": np.arange(len(values), dtype="int64"), "y": np.asarray(values, float)})
    return spark.createDataFrame(pdf, "series_id string, t long, y double")


def col(df, name, order="t"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_f24_reference_point(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 2.9), (4.0, 4.2), (5.0, 4.8)], "y_true double, y_pred double")
    out = me.forecast_metrics(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert out["f24"] == pytest.approx(0.0722222, abs=1e-7)


def test_smoothing_fixture(spark):
    df = series_df(spark, [1, 2, 3])
    assert col(sm.exp_smooth(df, 0.5), "s") == pytest.approx([1, 1.5, 2.25])
    assert col(sm.double_exp_smooth(df, 0.5), "s2") == pytest.approx([1, 1.25, 1.75])


def loop_smooth(x, a):
    out, s = [], None
    for i, v in enumerate(x):
        s = v if i == 0 else a * v + (1 - a) * s
        out.append(s)
    return out


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.9, 0.999999])
def test_scan_matches_loop_across_chunks(spark, small_chunks, alpha):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=200)) + 50
    df = series_df(spark, x)
    got = col(sm.exp_smooth(df, alpha), "s")
    assert got == pytest.approx(loop_smooth(x, alpha), rel=1e-9, abs=1e-9)


def test_running_sum_and_tiny_decay(spark, small_chunks):
    x = np.arange(1.0, 101.0)
    df = series_df(spark, x)
    rs = col(affine_scan(df, ["series_id"], "t", F.col("y"), 1.0, "s"), "s")
    assert rs == pytest.approx(np.cumsum(x).tolist())
    tiny = col(affine_scan(df, ["series_id"], "t", F.col("y"), 1e-200, "s"), "s")
    assert tiny == pytest.approx(x.tolist())


def test_ewm_matches_pandas(spark, small_chunks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120)
    df = series_df(spark, x)
    got = col(sm.ewm(df, 3, out="e"), "e")
    assert got == pytest.approx(pd.Series(x).ewm(span=3).mean().tolist(), rel=1e-9)


def test_zero_phase_matches_loop(spark, small_chunks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    df = series_df(spark, x)
    f = loop_smooth(loop_smooth(x, 0.3), 0.3)
    b = loop_smooth(loop_smooth(x[::-1], 0.3), 0.3)[::-1]
    got = col(sm.zero_phase_trend(df, 0.3), "trend")
    assert got == pytest.approx(((np.array(f) + np.array(b)) / 2).tolist(), rel=1e-9)


def test_window_features_cross_chunks(spark, small_chunks):
    x = np.arange(30, dtype=float) ** 2
    df = series_df(spark, x)
    out = fe.build_features(df).orderBy("t").toPandas()
    s = pd.Series(x)
    assert out["y_lag_8"].tolist()[8:] == s.shift(8).tolist()[8:]
    np.testing.assert_allclose(out["y_roll_std_12"].to_numpy()[11:], s.rolling(12).std().to_numpy()[11:])
    np.testing.assert_allclose(out["y_roll_mean_6"].to_numpy()[5:], s.rolling(6).mean().to_numpy()[5:])
    assert out["y_roll_mean_6"].isna().sum() == 5
    np.testing.assert_allclose(out["y_ewm_long"].to_numpy(), s.ewm(span=7).mean().to_numpy())
    tg = fe.multistep_targets(df, 3).orderBy("t").toPandas()
    assert len(tg) == 27 and tg["y_step_3"].tolist() == s.shift(-3).dropna().tolist()


@pytest.mark.parametrize("seas,diff", [(False, False), (False, True), (True, False), (True, True)])
def test_inversion_round_trip(spark, seas, diff):
    n, S = 40, 4
    y = (np.arange(n, dtype=float)) ** 2
    df = series_df(spark, y)
    ytr = tr.difference(df, seas, diff, season=S, out="y_tr")
    leads = fe.windowed(ytr, lambda w: [F.array(*[F.lead("y_tr", h).over(w) for h in (1, 2, 3)]).alias("p")], 0, 3)
    leads = leads.where(F.col("y_tr").isNotNull() & F.forall("p", lambda v: v.isNotNull()))
    pred = leads.select("series_id", "t", F.posexplode("p").alias("i", "y_pred")).select(
        "series_id", "t", (F.col("i") + 1).cast("long").alias("step"), "y_pred")
    inv = tr.invert_forecasts(pred, df, seas, diff, season=S).toPandas()
    expected = (inv["t"] + inv["step"]).astype(float) ** 2
    np.testing.assert_allclose(inv["y_pred_orig"].to_numpy(), expected.to_numpy())


def test_band_weight(spark):
    df = spark.createDataFrame([(5.9,), (6.0,), (32.0,), (32.1,)], "period double")
    out = col(qa.frequency_band_weights(df, horizons=(4,)), "weight", "period")
    assert out == [0.25, 1.0, 1.0, 0.5]


def test_metrics_single_step_weighted_equals_f24(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.5), ("a", 1, 2.0, 2.5)], "series_id string, step long, y_true double, y_pred double")
    m = me.forecast_metrics(df, ["series_id", "step"])
    w = me.weighted_f24(m, ["series_id"], weights=(1.0,)).first()["weighted_f24"]
    assert w == pytest.approx(m.first()["f24"])


def test_r2_constant_truth(spark):
    df = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 2.0, 2.0), ("b", 2.0, 3.0)],
                               "g string, y_true double, y_pred double")
    out = {r["g"]: r["r2"] for r in me.forecast_metrics(df, ["g"]).collect()}
    assert out == {"a": 1.0, "b": 0.0}


def test_orthogonality_identity(spark):
    rows = [("a", t, f"IMF_{k}", k, float(np.sin(t * k))) for t in range(20) for k in (1, 2, 3)]
    comps = spark.createDataFrame(rows, "series_id string, t long, component string, k long, value double")
    sig = comps.groupBy("series_id", "t").agg(F.sum("value").alias("y"))
    got = qa.orthogonality_index(comps, sig).first()[1]
    arr = np.array([[np.sin(t * k) for t in range(20)] for k in (1, 2, 3)])
    cross = sum(np.sum(arr[i] * arr[j]) for i in range(3) for j in range(i + 1, 3))
    assert got == pytest.approx(2 * abs(cross) / np.sum(arr ** 2))


def test_main_period_sine(spark):
    n = 96 * 4
    x = np.sin(2 * np.pi * np.arange(n) / 32) + 0.1
    got = qa.main_period(series_df(spark, x)).first()["main_period"]
    assert got == pytest.approx(32.0)


def test_degenerate_inputs(spark):
    empty = spark.createDataFrame([], "series_id string, t long, y double")
    assert fe.build_features(empty).count() == 0
    one = series_df(spark, [5.0])
    assert col(sm.exp_smooth(one, 0.3), "s") == [5.0]
    const = series_df(spark, [2.0] * 20)
    ac = tr.autocorr(const, lag=2).first()["autocorr"]
    assert ac is None


def test_scan_single_carry_path_across_chunks(spark):
    """decay^C underflows to 0 -> the one-join carry path; compare with the loop over several chunks."""
    from tidemark.operators import scan
    from tidemark.session import CHUNK_CONF

    rng = np.random.default_rng(9)
    x = rng.normal(size=8000) * 100
    size, how = scan._chunk_size(0.7, 1 << 17)
    assert how == "pow" and 0.7 ** size == 0.0 and size < 8000 / 2
    got = col(sm.exp_smooth(series_df(spark, x), 0.3), "s")
    assert got == pytest.approx(loop_smooth(x, 0.3), rel=1e-9, abs=1e-9)
    spark.conf.set(CHUNK_CONF, "40")
    try:
        alpha = 1 - 1e-9
        assert (1 - alpha) ** scan._chunk_size(1 - alpha, 40)[0] == 0.0
        got = col(sm.exp_smooth(series_df(spark, x[:300]), alpha), "s")
        assert got == pytest.approx(loop_smooth(x[:300], alpha), rel=1e-12, abs=1e-9)
    finally:
        spark.conf.unset(CHUNK_CONF)


def test_prediction_table_forms(spark):
    from tidemark.operators import metrics as me

    rows = [("a", 0, 1, 1.0, 2.0, 10.0, 20.0), ("a", 0, 2, 3.0, 4.0, 30.0, 40.0)]
    long = spark.createDataFrame(rows, "series_id string, t long, step long, y_true double, y_pred double, "
                                       "y_true_orig double, y_pred_orig double")
    wide = me.prediction_table(long, steps=(1, 2), literals={"run": "r1"}).first().asDict()
    assert wide == {"series_id": "a", "t": 0, "true_step_1": 1.0, "pred_step_1": 2.0, "true_orig_step_1": 10.0,
                    "pred_orig_step_1": 20.0, "true_step_2": 3.0, "pred_step_2": 4.0, "true_orig_step_2": 30.0,
                    "pred_orig_step_2": 40.0, "run": "r1"}
    alone = me.prediction_table(long.select("series_id", "t", "step", "y_pred"))
    assert alone.columns == ["series_id", "t", "pred_step_1", "pred_step_2"]
