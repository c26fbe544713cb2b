"""Embedding whitening by mixed-precision refinement.

Vectors become integers, so counts, sums and the covariance over the distinct
vectors are exact: tasks multiply whole numbers centred on the rounded mean and
Spark adds the products up.  One covariance matrix (its size follows the
dimension, not the data) reaches the driver.  Its eigenvectors are found in
float32 and corrected by Ogita-Aishima iterations, which are matrix products in
double and then extended precision; eigenvectors whose eigenvalues lie too
close together for that are rotated by an eigenproblem of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, written

# Scaled entries are held within +-2 ** MOST_BITS, so that sums of squares fit 38 digits.
MOST_BITS = 53
ROUNDS = 30  # refinement steps, at most; from float32 three or four are enough


# --- vectors as integers -----------------------------------------------------

def quantised(column, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(usable, q): rows of ``dim`` finite entries, and floor(scale * entry) of those."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    end = np.cumsum(length)
    start = end - length
    usable = (length == dim) & (bad[end] == bad[start])
    entries = values[start[usable][:, None] + np.arange(dim)].reshape(-1, dim)
    most = float(1 << MOST_BITS)
    return usable, np.clip(np.floor(entries * scale), -most, most).astype(np.int64)


def to_keys(q: np.ndarray) -> pa.Array:
    """One binary value per vector: 4 bytes an entry where all fit, else 8; equal vectors give equal bytes."""
    small = (np.abs(q) < (1 << 31)).all(axis=1) if len(q) else np.zeros(0, bool)
    narrow, wide = q[small].astype("<i4"), q[~small].astype("<i8")
    out = np.empty(len(q), object)
    out[small] = [r.tobytes() for r in narrow]
    out[~small] = [r.tobytes() for r in wide]
    return pa.array(out.tolist(), pa.binary())


def from_keys(column, dim: int) -> np.ndarray:
    q = np.zeros((len(column), dim), np.int64)
    for k, blob in enumerate(column.to_pylist()):
        q[k] = np.frombuffer(blob, "<i4" if len(blob) == 4 * dim else "<i8")
    return q


def exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers, as Python integers; in doubles where those are exact."""
    if y.size and int(np.abs(y).max()) ** 2 * len(y) >= 1 << 53:
        wide = y.astype(object)
        return wide.T @ wide
    whole = y.astype(np.float64)
    return (whole.T @ whole).astype(np.int64).astype(object)


# --- eigenvectors ------------------------------------------------------------

def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: (better x, eigenvalues, pairs too close to correct, size of the correction)."""
    rest = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(rest))
    size = np.sqrt((a * a).sum())
    error = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + size * np.sqrt((rest * rest).sum()))
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= error
    step = np.where(near, rest / 2, (s + value[None, :] * rest) / np.where(near, 1, gap))
    return x + x @ step, value, near, float(np.abs(step).max())


def clusters(near: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """Runs of eigenvalues, in order of size, whose neighbours are too close."""
    order = np.argsort(value)
    breaks = np.flatnonzero(~near[order[:-1], order[1:]]) + 1
    return [run for run in np.split(order, breaks) if len(run) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric extended-precision matrix."""
    d = len(a)
    unit = np.abs(a).max() if d else 0
    if not d or unit == 0:
        return np.zeros(d), np.eye(d)
    a = a / unit
    _, x = np.linalg.eigh(a.astype(np.float32))
    value = np.diag(a)
    for kind in (np.float64, np.longdouble):
        work, x = a.astype(kind), x.astype(kind)
        tiny = d * float(np.finfo(kind).eps)
        for _ in range(ROUNDS):
            x, value, near, moved = refine(work, x)
            turned = 0.0
            for run in clusters(near, value):
                # the sub-problem shifted to the cluster's own size separates its members
                part, middle = x[:, run], value[run].mean()
                block = part.T @ (work @ part) - middle * (part.T @ part)
                own = float(np.abs(block).max())
                off = float(np.abs(block - np.diag(np.diag(block))).max())
                if off <= tiny or own == 0:
                    continue
                _, turn = np.linalg.eigh((block / own).astype(np.float64))
                x[:, run] = part @ turn.astype(kind)
                turned = max(turned, off)
            if moved <= tiny and turned <= tiny:
                break
    x = x + x @ (np.eye(d, dtype=x.dtype) - x.T @ x) / 2
    value = (x * (work @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return value[order] * unit, x[:, order]


# --- the model ---------------------------------------------------------------

@dataclass
class Whitening:
    """n distinct vectors with the sums ``total`` of their scaled entries, the
    leading eigenvalues (``value``) and eigenvectors (columns of ``vector``)
    of their covariance, its ``trace``, and the largest entry of the whitened
    covariance minus the identity as measured over all n."""
    dim: int
    scale: float
    shift: int
    n: int
    total: list[int]
    value: np.ndarray
    vector: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, q: np.ndarray) -> np.ndarray:
        """n * x - S, whole numbers: the shift of x cancels."""
        most = int(np.abs(q).max()) if q.size else 0
        if (most + max((abs(t) for t in self.total), default=0) // max(self.n, 1) + 1) * self.n < 1 << 62:
            return q * self.n - np.array(self.total, np.int64)
        return q.astype(object) * self.n - np.array(self.total, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.where(self.value > 0, 1 / np.sqrt(self.value), np.nan)
        return (centred.astype(np.float64) / self.n) @ self.vector * root


def deviation(centred: np.ndarray) -> list:
    """Exact sums of squares; None beyond 64 bits."""
    most = int(np.abs(centred).max()) if centred.size else 0
    if most * most * max(centred.shape[1], 1) < 1 << 63:
        whole = centred.astype(np.int64)
        return (whole * whole).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in centred]
    return [s if s < 1 << 63 else None for s in sums]


def _common_length(vectors: DataFrame) -> int:
    """The most frequent length of the vectors; of equally frequent ones the longest."""
    rows = vectors.where(F.size("_vector") > 0).groupBy(F.size("_vector").alias("dim")).count()
    best = rows.orderBy(F.desc("count"), F.desc("dim")).first()
    return int(best["dim"]) if best else 0


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", components: int = 16, scale: float = 64.0,
                  shift: int = 1_000_000) -> Whitening | None:
    """The whitening of x = floor(scale * entry) + shift, fitted on each distinct
    x vector once (divisor n, centred before multiplying).

    Null vectors, empty ones, those holding a null or non-finite entry and those
    of another than the most frequent length take no part; without any vector
    the result is None.  Components whose variance is 0 to double precision
    have eigenvalue 0.  Scaled entries beyond 2 ** 53 count as 2 ** 53.
    """
    prepare(vectors.sparkSession)
    vectors = vectors.select(F.col(vec_col).alias("_vector"))
    dim = _common_length(vectors)
    if dim == 0:
        return None

    def keys(batches):
        for batch in batches:
            _, q = quantised(batch.column(0), dim, scale)
            yield pa.RecordBatch.from_arrays([to_keys(q)], names=["key"])

    distinct = written(vectors.mapInArrow(keys, "key binary").distinct(), "whitening-fit")

    def sums(batches):
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            q = from_keys(batch.column(0), dim)
            n += len(q)
            total += (q >> 31).sum(axis=0).astype(object) * (1 << 31) + (q & 0x7FFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in [n, *total]], pa.string())],
                names=["i", "v"])

    exact = F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    found = {r["i"]: int(r["v"]) for r in distinct.mapInArrow(sums, "i int, v string").groupBy("i").agg(exact).collect()}
    if not found:
        return None
    n, total = found[-1], [found[i] for i in range(dim)]
    middle = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)  # the rounded mean
    upper = np.triu_indices(dim)

    def products(batches):
        total = np.zeros((dim, dim), object)
        for batch in batches:
            total = total + exact_product(from_keys(batch.column(0), dim) - middle)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
             pa.array([str(v) for v in total[upper]], pa.string())], names=["i", "j", "v"])

    rows = distinct.mapInArrow(products, "i int, j int, v string").groupBy("i", "j").agg(exact).collect()
    # n^2 V = n sum(y y') - sum(y) sum(y)', whole numbers: y is within half a unit of centred
    rest = [t - n * int(m) for t, m in zip(total, middle)]
    v = np.zeros((dim, dim), np.longdouble)
    trace = 0
    for r in rows:
        whole = n * int(r["v"]) - rest[r["i"]] * rest[r["j"]]
        head = float(whole)
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = np.longdouble(head) + np.longdouble(float(whole - int(head)))
        trace += whole if r["i"] == r["j"] else 0
    value, vector = eigen(v / (np.longdouble(n) * np.longdouble(n)))
    keep = min(components, dim)
    value = np.where(value > dim * np.finfo(np.float64).eps * max(value[0], 0), value, 0)[:keep].astype(np.float64)
    model = Whitening(dim, scale, shift, n, total, value, vector[:, :keep].astype(np.float64), trace / n / n)
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, over components with variance."""
    live = np.flatnonzero(model.value > 0)
    if not len(live):
        return None
    upper = np.triu_indices(len(live))

    def products(batches):
        product, total = np.zeros((len(live), len(live))), np.zeros(len(live))
        for batch in batches:
            z = model.project(model.centred(from_keys(batch.column(0), model.dim)))[:, live]
            product += z.T @ z
            total += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([upper[0], np.arange(len(live))]), pa.int32()),
             pa.array(np.concatenate([upper[1], np.full(len(live), -1)]), pa.int32()),
             pa.array(np.concatenate([product[upper], total]))], names=["i", "j", "v"])

    rows = {(r["i"], r["j"]): r["v"] for r in
            distinct.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = [rows[(k, -1)] / model.n for k in range(len(live))]
    return max(abs(rows[(i, j)] / model.n - mean[i] * mean[j] - (i == j)) for i, j in zip(*upper))


def whiten_vectors(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector (as in ``fit_whitening``; repeated rows and null
    ids too) and component: id, component (from 1, by falling eigenvalue), n,
    deviation (sum over dimensions of (n x - S)^2, exact; null beyond 64 bits),
    whitened (null for a component without variance), explained (share of the
    covariance's trace), identity_error.  Without a model: no rows."""
    prepare(vectors.sparkSession)
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vector"))
    kind = source.schema["_id"].dataType.simpleString()
    keep = 0 if model is None else len(model.value)

    def run(batches):
        for batch in batches:
            if model is None:
                continue
            usable, q = quantised(batch.column(1), model.dim, model.scale)
            centred = model.centred(q)
            m = len(q)
            ids = batch.column(0).filter(pa.array(usable)).take(pa.array(np.repeat(np.arange(m), keep)))
            share = model.value / model.trace if model.trace else np.zeros(keep)
            deviations = np.repeat(np.array(deviation(centred), object), keep)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, keep + 1), m), pa.int32()),
                 pa.array(np.full(m * keep, model.n), pa.int64()), pa.array(deviations.tolist(), pa.int64()),
                 pa.array(model.project(centred).ravel(), pa.float64(), from_pandas=True),
                 pa.array(np.tile(share, m), pa.float64()),
                 pa.array([model.identity_error] * (m * keep), pa.float64())],
                names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = source.mapInArrow(run, f"_id {kind}, component int, n long, deviation long, whitened double, "
                                 "explained double, identity_error double")
    return out.withColumnRenamed("_id", id_col)
