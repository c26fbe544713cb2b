"""Histogram boosting against a plain booster that tries every split row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as bo

SMALL = dict(depth=3, min_rows=5, rate=0.3, trees=6)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)).round(3)
    y = np.stack([np.sin(2 * x[:, 0]) + x[:, 1] ** 2, x[:, 0] * x[:, 2], np.abs(x[:, 1])], axis=1) + rng.normal(size=(600, 3)) * .05
    rows = [("s", k, *map(float, x[k]), *map(float, y[k])) for k in range(600)]
    rows += [("s", 1000, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("s", 1001, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0),
             ("s", 1002, 1.0, 1.0, 1.0, float("inf"), 1.0, 1.0)]
    return spark.createDataFrame(rows, "series_id string, t long, a double, b double, `c.d` double, "
                                       "y1 double, y2 double, y3 double").cache()


FEATURES, TARGETS = ["a", "b", "c.d"], ["y1", "y2", "y3"]


def split(table):
    return table.where("t < 450 OR t >= 1000"), table.where("t BETWEEN 450 AND 599")


def plain_tree(bins, g, rows, p, turn, node=0, level=0, out=None):
    """Recursive growth: {heap number: (column, cut)} and leaf values."""
    out = {} if out is None else out
    def score(r):
        shrunk = np.maximum(np.abs(g[r].sum(axis=0)) - p.l1, 0)
        return (shrunk ** 2).sum() / (len(r) + p.l2)
    total = g[rows].sum(axis=0)
    out[node] = ("leaf", -p.rate * np.sign(total) * np.maximum(np.abs(total) - p.l1, 0) / (len(rows) + p.l2))
    if level == p.depth:
        return out
    best = (p.gamma, None)
    for c in bo.sampled_columns(p, turn, level, bins.shape[1]):
        for cut in range(int(bins[:, c].max()) + 1):
            left, right = rows[bins[rows, c] <= cut], rows[bins[rows, c] > cut]
            if len(left) >= p.min_rows and len(right) >= p.min_rows:
                gain = score(left) + score(right) - score(rows)
                if gain > best[0] + 1e-12:
                    best = (gain, (c, cut, left, right))
    if best[1]:
        c, cut, left, right = best[1]
        out[node] = (c, cut)
        plain_tree(bins, g, left, p, turn, 2 * node + 1, level + 1, out)
        plain_tree(bins, g, right, p, turn, 2 * node + 2, level + 1, out)
    return out


def plain_boost(bins, y, ids, p, base):
    pred = np.tile(base, (len(y), 1))
    for turn in range(p.trees):
        rows = np.flatnonzero(bo.sampled_rows(p, turn, ids))
        nodes = plain_tree(bins, pred - y, rows, p, turn)
        for i in range(len(bins)):
            k = 0
            while nodes[k][0] != "leaf":
                c, cut = nodes[k]
                k = 2 * k + 1 + int(bins[i, c] > cut)
            pred[i] += nodes[k][1]
    return pred


@pytest.mark.parametrize("outputs", [[0], [0, 1, 2]])
def test_equals_a_plain_booster(table, outputs):
    train, _ = split(table)
    p = bo.BoostParams(**SMALL, l1=0.4, gamma=0.2, level_columns=0.7)
    [model] = bo.fit_boosters(train, None, FEATURES, TARGETS, [bo.Fit(outputs, p)], width=16)
    pdf = train.where("t < 450").withColumn("id", F.xxhash64("series_id", "t")).toPandas()
    bins = bo.to_bins([pdf[c].to_numpy() for c in FEATURES], model.edges)
    y = pdf[TARGETS].to_numpy()[:, outputs]
    assert len(pdf) == 450 and np.allclose(model.base, y.mean(axis=0))
    want = plain_boost(bins, y, pdf["id"].to_numpy(), p, model.base)
    assert np.allclose(model.predict(bins), want, atol=1e-5)


def test_levels_over_blocks_give_the_same_trees(table, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 70)
    monkeypatch.setattr(bo, "STATE_ROUNDS", 2)
    train, val = split(table)
    fits = [bo.Fit([0], bo.BoostParams(**SMALL)), bo.Fit([0, 1, 2], bo.BoostParams(**{**SMALL, "rate": 0.9, "trees": 4}))]
    one = bo.fit_boosters(train, val, FEATURES, TARGETS, fits, width=16)
    many = bo.fit_boosters(train.repartition(5), val, FEATURES, TARGETS, fits, width=16, task_rows=100)
    for a, b in zip(one, many):
        assert len(a.trees) == len(b.trees) == len(a.losses) == a.params.trees
        assert np.allclose(a.losses, b.losses, rtol=1e-9)
        for s, t in zip(a.trees, b.trees):
            assert (s.column == t.column).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value, atol=1e-12)


def test_patience_ends_the_rounds(table):
    train, val = split(table)
    p = bo.BoostParams(rate=1.0, trees=200, depth=6, min_rows=2)
    [whole] = bo.fit_boosters(train, val, FEATURES, TARGETS, [bo.Fit([1], p)])
    [short] = bo.fit_boosters(train, val, FEATURES, TARGETS, [bo.Fit([1], p)], patience=5)
    best = int(np.argmin(short.losses))
    assert len(short.losses) == best + 6 < 200
    assert whole.losses[:len(short.losses)] == short.losses
    assert len(short.stopped(5).trees) == best + 1 == len(whole.stopped(5).trees)


def test_staged_forecasts_and_importance(table):
    train, val = split(table)
    [model] = bo.fit_boosters(train, None, FEATURES, TARGETS, [bo.Fit([0, 1, 2], bo.BoostParams(trees=20, rate=0.3))])
    got = bo.predict_boosters([model], val, counts=[[5, 20]]).toPandas()
    assert len(got) == 150 * 2 * 3 and set(got["step"]) == {1, 2, 3}
    short = bo.predict_boosters([model.first(5)], val).toPandas()
    key = ["t", "step"]
    assert np.allclose(got[got.trees == 5].sort_values(key)["y_pred"], short.sort_values(key)["y_pred"])
    truth = val.select("t", F.posexplode(F.array(*TARGETS)).alias("k", "y")).toPandas()
    both = got[got.trees == 20].assign(k=lambda d: d.step - 1).merge(truth, on=["t", "k"])
    for _, part in both.groupby("step"):
        assert ((part.y - part.y_pred) ** 2).mean() < 0.3 * part.y.var()
    assert abs(model.importance.sum() - 1) < 1e-12


def test_parameters_empty_tables_and_constant_columns(table, spark):
    train, val = split(table)
    with pytest.raises(ValueError):
        bo.fit_boosters(train, None, FEATURES, TARGETS, [bo.Fit([0], bo.BoostParams(rate=7))])
    [none] = bo.fit_boosters(train.where("t < 0"), None, FEATURES, TARGETS, [bo.Fit([0], bo.BoostParams(trees=3))])
    assert none.trees == [] and {r["y_pred"] for r in bo.predict_boosters([none], val).collect()} == {0.0}
    flat = train.withColumn("a", F.lit(1.0)).withColumn("y1", F.lit(2.5))
    [model] = bo.fit_boosters(flat, val, ["a"], ["y1"], [bo.Fit([0], bo.BoostParams(trees=3))])
    assert {r["y_pred"] for r in bo.predict_boosters([model], flat.where("t < 5")).collect()} == {2.5}


def test_histograms_hold_one_column_of_keys_at_a_time():
    """Counts and sums by node, column and bin; no array of all rows and columns is made beside the bins."""
    import tracemalloc

    rng = np.random.default_rng(5)
    bins, rows = rng.integers(0, 8, (40, 20_000)).astype(np.uint8), np.arange(0, 20_000, 2)
    node, g = rng.integers(0, 3, len(rows)), rng.integers(-99, 99, (len(rows), 2)).astype(float)
    tracemalloc.start()
    n, sums = bo.histogram(bins, rows, node, g, 3, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(rows) * len(bins) / 2
    for at, column, b in ((0, 0, 0), (1, 7, 3), (2, 39, 7)):
        here = (node == at) & (bins[column, rows] == b)
        assert n[at, column, b] == here.sum() and (sums[:, at, column, b] == g[here].sum(axis=0)).all()
    assert n.sum() == len(rows) * len(bins) and np.allclose(sums.sum(axis=(1, 3)), g.sum(axis=0)[:, None])
