"""Readers and sinks: CSV batches with a byte-order mark, wide/long round trip, model save/load."""

import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import models as mo
from tidemark.sources import sinks
from tidemark.sources.series import (clean_series, components_to_long, components_to_wide, pick_value_col,
                                     read_series_batch, synthetic_components)


def test_read_series_batch_bom_and_order(spark):
    d = tempfile.mkdtemp(prefix="tidemark-test-")
    for name, vals in (("alpha", [3.0, 1.0, None, 2.0]), ("beta", [5.0, 6.0])):
        pdf = pd.DataFrame({"speed(m/s)": vals, "note": ["x"] * len(vals)})
        pdf.to_csv(os.path.join(d, f"{name}.csv"), index=False, encoding="utf-8-sig")
    df = read_series_batch(spark, os.path.join(d, "*.csv"), value_col="speed(m/s)")
    got = {(r.series_id, r.t): r.y for r in df.collect()}
    assert got[("alpha", 0)] == 3.0 and got[("alpha", 3)] == 2.0 and got[("beta", 1)] == 6.0
    cleaned = clean_series(df, min_len=3)
    rows = sorted((r.series_id, r.t, r.y) for r in cleaned.collect())
    assert rows == [("alpha", 0, 3.0), ("alpha", 1, 1.0), ("alpha", 2, 2.0)]


def test_pick_value_col(spark):
    df = spark.createDataFrame([("a", 1.5)], "name string, v double")
    assert pick_value_col(df) == "v"


def test_wide_long_round_trip(spark):
    wide = synthetic_components(spark, n_series=2, n=20, k=3, seed=7).drop("date")
    long = components_to_long(wide)
    back = components_to_wide(long)
    a = wide.orderBy("series_id", "t").toPandas()
    b = back.orderBy("series_id", "t").toPandas()[a.columns]
    np.testing.assert_allclose(a[["IMF_1", "IMF_2", "IMF_3", "residual"]], b[["IMF_1", "IMF_2", "IMF_3", "residual"]])
    assert long.select("k").distinct().count() == 4


def test_synthetic_moments(spark):
    wide = synthetic_components(spark, n_series=1, n=3000, k=1, seed=1)
    m = wide.agg(F.avg("IMF_1"), F.stddev("IMF_1")).first()
    assert abs(m[0] - 50) < 1.0 and abs(m[1] - 10) < 1.0


def test_sinks_and_models(spark):
    d = tempfile.mkdtemp(prefix="tidemark-test-")
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "series_id string, t long, y double")
    sinks.write_table(df, f"{d}/tbl", "csv", partition_by="series_id")
    assert spark.read.option("header", True).csv(f"{d}/tbl").count() == 2
    sinks.write_json(df, f"{d}/js", nested={"point": ["t", "y"]})
    assert "point" in spark.read.json(f"{d}/js").columns
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"series_id": "a", "t": np.arange(200), "x1": rng.normal(size=200)})
    pdf["y_tr_step_1"] = 2 * pdf["x1"]
    train = spark.createDataFrame(pdf)
    fit = mo.fit_boosted_multistep(train, ["x1"], steps=1, n_trees=5)
    sinks.save_models(fit["models"], f"{d}/m")
    loaded = sinks.load_models(f"{d}/m")
    p1 = mo.predict_multistep(fit["models"], train, ["x1"]).orderBy("t").toPandas()["y_pred"]
    p2 = mo.predict_multistep(loaded, train, ["x1"]).orderBy("t").toPandas()["y_pred"]
    np.testing.assert_allclose(p1, p2)


def test_joint_models_are_saved_whole(spark):
    d = tempfile.mkdtemp(prefix="tidemark-test-")
    train = spark.range(300).selectExpr("'a' AS series_id", "id AS t", "sin(id) AS x", "cos(id) AS z",
                                        "sin(id) * 2 AS y_tr_step_1", "sin(id) + cos(id) AS y_tr_step_2")
    models = mo.fit_boosted_multistep(train, ["x", "z"], 2, n_trees=6, joint=True)["models"]
    sinks.save_models(models, f"{d}/m")
    sinks.save_models(models, f"{d}/m")  # saved again: replaced, not added
    [back] = sinks.load_models(f"{d}/m")
    assert back.params == models[0].params and back.steps == [1, 2] and len(back.trees) == 6
    p1, p2 = (mo.predict_multistep(m, train).orderBy("step", "t").toPandas()["y_pred"] for m in (models, [back]))
    assert p1.tolist() == p2.tolist() and back.importance.tolist() == models[0].importance.tolist()


def test_read_series_batch_keeps_order_across_many_splits(spark):
    d = tempfile.mkdtemp(prefix="tidemark-test-")
    vals = np.arange(2000, dtype=float) * 1.5
    pd.DataFrame({"value": vals}).to_csv(os.path.join(d, "long.csv"), index=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        df = read_series_batch(spark, os.path.join(d, "*.csv"), value_col="value")
        got = df.orderBy("t").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["t"].tolist() == list(range(2000))
    np.testing.assert_allclose(got["y"].to_numpy(), vals)


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_read_series_batch_goes_by_each_files_header(spark):
    from tidemark.sources.series import batch_file_status

    d = tempfile.mkdtemp(prefix="tidemark-test-")
    _write(d, "a.csv", "a,v\n1,10\n2,20\n3,30\n")
    _write(d, "b.csv", "v,a\n5,1\n6,2\n")
    _write(d, "c.csv", "x,y\n1,1\n")
    got = {(r.series_id, r.t): r.y for r in read_series_batch(spark, f"{d}/*.csv", value_col="v").collect()}
    assert got == {("a", 0): 10.0, ("a", 1): 20.0, ("a", 2): 30.0, ("b", 0): 5.0, ("b", 1): 6.0}
    status = {r.series_id: (r.status, r.n_rows) for r in batch_file_status(spark, f"{d}/*.csv", "v").collect()}
    assert status == {"a": ("Success", 3), "b": ("Success", 2), "c": ("Error", 1)}
    first = {(r.series_id, r.t): r.y for r in read_series_batch(spark, f"{d}/*.csv").collect()}
    assert first[("a", 0)] == 1.0 and first[("b", 0)] == 5.0 and first[("c", 0)] == 1.0


def test_read_series_batch_orders_by_timestamp(spark, small_chunks):
    from tidemark.sources.series import batch_file_status

    d = tempfile.mkdtemp(prefix="tidemark-test-")
    rows = [(f"2024-01-01 00:{59 - k:02d}:00", k) for k in range(30)]
    rows[4:4] = [("", 100), ("2024-01-01 00:59:00", 200)]  # one without, one repeated timestamp
    _write(d, "s.csv", "ts,v\n" + "".join(f"{a},{b}\n" for a, b in rows))
    got = read_series_batch(spark, f"{d}/*.csv", value_col="v", ts_col="ts").orderBy("t").collect()
    assert [r.t for r in got] == list(range(31))
    assert [r.y for r in got] == [float(k) for k in range(29, 0, -1)] + [0.0, 200.0]
    status = batch_file_status(spark, f"{d}/*.csv", "v", "ts").first()
    assert (status.n_rows, status.n_without_ts) == (32, 1)


def test_select_by_prefix(spark):
    from tidemark.sources.series import select_by_prefix

    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "t long, IMF_1 double, IMF_2 double, residual double")
    assert select_by_prefix(df) == ["IMF_1", "IMF_2", "residual"]
