"""Random series of awkward lengths against pandas/NumPy one-liners (tiny chunks on)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import metrics as me
from tidemark.operators import quality as qa
from tidemark.operators import smoothing as sm
from tidemark.operators import splits as sp
from tidemark.sources.series import clean_series


def frame(spark, arrays):
    rows = [(sid, t, None if v is None else float(v)) for sid, x in arrays.items() for t, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "t", "y"]) if rows else
                                 pd.DataFrame({"series_id": pd.Series([], dtype=str), "t": pd.Series([], dtype="int64"),
                                               "y": pd.Series([], dtype=float)}), "series_id string, t long, y double")


LENGTHS = [0, 1, 2, 12, 97]


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(11)
    out = {f"n{n}": rng.normal(size=n) * 50 - 20 for n in LENGTHS}
    out["const"] = np.full(30, 3.25)
    return out


def test_features_match_pandas(spark, small_chunks, arrays):
    out = fe.build_features(frame(spark, arrays)).toPandas()
    for sid, x in arrays.items():
        got = out[out.series_id == sid].sort_values("t")
        s = pd.Series(x, dtype=float)
        assert len(got) == len(x)
        if len(x) == 0:
            continue
        for k in (1, 8):
            np.testing.assert_allclose(got[f"y_lag_{k}"].to_numpy(dtype=float), s.shift(k).to_numpy(), equal_nan=True)
        for w in (3, 12):
            np.testing.assert_allclose(got[f"y_roll_mean_{w}"].to_numpy(dtype=float), s.rolling(w).mean().to_numpy(),
                                       rtol=1e-9, atol=1e-9, equal_nan=True)
            np.testing.assert_allclose(got[f"y_roll_std_{w}"].to_numpy(dtype=float), s.rolling(w).std().to_numpy(),
                                       rtol=1e-7, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(got["y_diff_2"].to_numpy(dtype=float), s.diff(2).to_numpy(), equal_nan=True)
        np.testing.assert_allclose(got["y_ewm_short"].to_numpy(), s.ewm(span=3).mean().to_numpy(), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got["slot_in_day"].to_numpy(), np.arange(len(x)) % 96)


def test_double_smoothing_matches_loop(spark, small_chunks, arrays):
    out = sm.double_exp_smooth(frame(spark, arrays), 0.2).toPandas()
    for sid, x in arrays.items():
        got = out[out.series_id == sid].sort_values("t")["s2"].to_numpy()
        s1, s2, acc1, acc2 = [], [], 0.0, 0.0
        for i, v in enumerate(x):
            acc1 = v if i == 0 else 0.2 * v + 0.8 * acc1
            acc2 = acc1 if i == 0 else 0.2 * acc1 + 0.8 * acc2
            s2.append(acc2)
        np.testing.assert_allclose(got, np.array(s2), rtol=1e-9, atol=1e-9)


def test_split_bounds(spark, small_chunks, arrays):
    out = sp.temporal_split(frame(spark, arrays)).toPandas()
    for sid, x in arrays.items():
        n = len(x)
        got = out[out.series_id == sid].sort_values("t")["split"].tolist()
        want = ["train" if i < int(n * 0.6) else "val" if i < int(n * 0.8) else "test" for i in range(n)]
        assert got == want


def test_clean_series_all_null_and_gaps(spark, small_chunks):
    df = frame(spark, {"gappy": [1.0, None, 2.0, None, None, 3.0], "nulls": [None, None]})
    got = sorted((r.series_id, r.t, r.y) for r in clean_series(df, min_len=1).collect())
    assert got == [("gappy", 0, 1.0), ("gappy", 1, 2.0), ("gappy", 2, 3.0)]


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(4)
    y, p = rng.normal(size=40) + 5, rng.normal(size=40) + 5
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "y_true": y, "y_pred": p}))
    m = me.forecast_metrics(df, ["g"]).first()
    e = p - y
    assert m.rmse == pytest.approx(np.sqrt(np.mean(e ** 2)))
    assert m.mae == pytest.approx(np.mean(np.abs(e)))
    assert m.r2 == pytest.approx(1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2))
    assert m.mape == pytest.approx(np.mean(np.abs(e / (y + 1e-8))) * 100)


def test_quality_on_constant_and_zero_energy(spark):
    rows = [("z", t, c, k, 0.0) for t in range(20) for k, c in ((1, "IMF_1"), (2, "residual"))]
    comps = spark.createDataFrame(rows, "series_id string, t long, component string, k long, value double")
    sig = comps.groupBy("series_id", "t").agg(F.sum("value").alias("y"))
    st = qa.series_stats(comps, sig).first()
    assert st.K == 1
    assert qa.orthogonality_index(comps, sig).first()[1] == 0.0
    assert qa.energy_gap(comps, sig).first()[1] == 0.0
    assert qa.rrmse(comps, sig, "power").first()[1] == 0.0
    # nine windows, all with variance 0: a non-positive mean variance scores 1
    assert qa.variance_stability(comps).first()["variance_stability"] == 1.0
