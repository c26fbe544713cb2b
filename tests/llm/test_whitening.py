import math
from fractions import Fraction

import numpy as np
import pytest

import tidemark.llm.queries as registered
from tidemark.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors):
    """n, sums and covariance of the distinct integer vectors, in fractions."""
    rows = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(rows), len(rows[0])
    sums = [sum(r[k] for r in rows) for k in range(d)]
    y = np.array([[n * r[k] - sums[k] for k in range(d)] for r in rows], object)
    return n, sums, (y.T @ y), n ** 3


def test_whole_table_against_plain_numbers(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    out = registered.QUERIES["op11_embedding_whitening"](spark, SF).toPandas()
    n, sums, product, scale = plain([r["embedding"] for r in rows])
    assert len(out) == 16 * len(rows) and set(out["n"]) == {n}
    cov = np.array([[float(Fraction(v, scale)) for v in r] for r in product.tolist()])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    wide = out.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in rows], float)
    centred = x - np.array([float(Fraction(s, n)) for s in sums])
    for k in range(16):
        want = centred @ vector[:, k] / math.sqrt(value[k])
        got = wide[k + 1].to_numpy()
        assert np.allclose(got * np.sign(got @ want), want, atol=1e-8)
    share = out.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, value[:16] / np.trace(cov), rtol=1e-10)
    exact = {r["vec_id"]: sum((n * (math.floor(64 * c) + 1_000_000) - s) ** 2 for c, s in zip(r["embedding"], sums))
             for r in rows}
    assert dict(zip(out["vec_id"], out["deviation"])) == exact


@pytest.mark.parametrize("values", [
    [5.0, 4, 3, 2, 1, 0.5],
    [1.0, 1, 1, 1, 1, 1],
    [2.0, 1 + 1e-7, 1, 1 - 1e-7, 1e-3, 0],
    [1e8, 1, 1 + 1e-12, 1e-6, 1e-6, 3],
    [0.0, 0, 0, 0, 0, 0],
])
def test_eigenvectors_with_clusters(values):
    rng = np.random.default_rng(4)
    basis, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    basis = basis.astype(np.longdouble)
    basis = basis + basis @ (np.eye(6) - basis.T @ basis) / 2
    a = basis @ np.diag(np.array(values, np.longdouble)) @ basis.T
    a = (a + a.T) / 2
    value, vector = whitening.eigen(a)
    top = max(values) or 1
    assert np.all(np.diff(value) <= 1e-15 * top)
    assert np.abs(value - np.sort(values)[::-1]).max() <= 1e-15 * top
    assert np.abs(vector.T @ vector - np.eye(6)).max() < 1e-15
    assert np.abs(a @ vector - vector * value).max() <= 1e-14 * top


def test_cluster_members_are_separated():
    """A pair 1e-9 apart: float32 mixes it, the sub-solve must not."""
    rng = np.random.default_rng(8)
    basis, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    basis = basis.astype(np.longdouble)
    for _ in range(2):
        basis = basis + basis @ (np.eye(5) - basis.T @ basis) / 2
    a = basis @ np.diag(np.array([3, 1 + 1e-9, 1, 0.2, 0.1], np.longdouble)) @ basis.T
    _, vector = whitening.eigen((a + a.T) / 2)
    assert np.abs(np.abs((vector * basis).sum(axis=0)) - 1).max() < 1e-8


def test_unusable_vectors_and_odd_tables(spark):
    good = [[0.5, -0.25, 1.0], [0.1, 0.2, 0.3], [-1.0, 0.0, 2.0], [0.7, 0.7, -0.7], [0.5, -0.25, 1.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(good)] + [(None, good[1], 1, "x"), (3, good[0], 1, "x")]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows += [(100 + i, v, 1, "x") for i, v in enumerate(odd)]
    schema = "vec_id long, embedding array<float>, component int, _vector string"
    table = spark.createDataFrame(rows, schema)
    model = whitening.fit_whitening(table, components=16)
    assert model.n == 4 and len(model.value) == 3 and model.identity_error < 1e-12
    out = whitening.whiten_vectors(table, model).toPandas()
    assert len(out) == 3 * 7 and out["vec_id"].isna().sum() == 3
    again = spark.createDataFrame(rows * 3, schema).repartition(7)
    assert whitening.fit_whitening(again).total == model.total

    # one vector, no variance: null coordinates; no vector: no rows
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten_vectors(one, whitening.fit_whitening(one)).collect()
    assert len(got) == 4 and {(r["whitened"], r["explained"], r["deviation"], r["n"]) for r in got} == {(None, 0.0, 0, 1)}
    empty = one.where("vec_id > 5")
    assert whitening.whiten_vectors(empty, whitening.fit_whitening(empty)).count() == 0


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(4)],
                                  "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(table)
    assert (model.value > 0).sum() == 3 and model.identity_error < 1e-12
    out = whitening.whiten_vectors(table, model).toPandas()
    assert len(out) == 24 and out["whitened"].isna().sum() == 12


def test_huge_entries_stay_exact(spark):
    rows = [(0, [1e13, 1.0]), (1, [-1e13, 2.0]), (2, [3.0, 4.0]), (3, [1e30, 0.0])]
    table = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(table)
    assert model.total == [192, 64 + 128 + 256] and model.identity_error < 1e-9
    out = whitening.whiten_vectors(table, model).toPandas()
    small = sum((3 * x - s) ** 2 for x, s in zip((192, 256), model.total))
    assert out[out.vec_id == 2]["deviation"].tolist() == [small] * 2 and out[out.vec_id == 0]["deviation"].isna().all()
    assert whitening.whiten_vectors(spark.createDataFrame(rows, table.schema), model).count() == 8
