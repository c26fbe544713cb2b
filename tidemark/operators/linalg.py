"""Least squares from aggregated sums (R8) and the prefix-sum helper it needs.

Any OLS / ridge fit only needs sum(z z^T) over its rows.  Partial Gram
matrices are built per (key, chunk) of bounded size, added up by a shuffle on
(key, entry), and solved in small batches with NumPy inside Arrow UDFs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indexing import chunk_of, key_schema
from tidemark.operators.scan import max_group_length
from tidemark.session import chunk_rows


def running_sums(df: DataFrame, keys, idx: str, cols, max_len: int | None = None, size: int | None = None,
                 level: int = 0) -> DataFrame:
    """Replace ``cols`` by their inclusive running sums along ``idx`` per key group.

    Window sums inside (keys, chunk); chunk totals are scanned recursively
    (a table ``size`` times smaller) and joined back as carries.  ``idx``
    must be a non-negative integer position (gaps allowed).
    """
    keys, cols = list(keys), list(cols)
    size = size or chunk_rows(df.sparkSession)
    if max_len is None:
        max_len = max_group_length(df, keys, idx)
    c = f"_rc{level}"
    staged = df.withColumn(c, chunk_of(idx, size))
    w = Window.partitionBy(*keys, c).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.select(*[F.col(x) for x in staged.columns if x not in cols],
                           *[F.sum(x).over(w).alias(x) for x in cols])
    if max_len <= size:
        return staged.drop(c).select(*df.columns)
    totals = staged.groupBy(*keys, c).agg(*[F.max_by(F.col(x), F.col(idx)).alias(x) for x in cols])
    carried = running_sums(totals, keys, c, cols, -(-max_len // size), size, level + 1)
    carry = carried.select(*keys, (F.col(c) + 1).alias(c), *[F.col(x).alias(f"_cy_{x}") for x in cols])
    joined = staged.join(carry, on=[*keys, c], how="left")
    out = joined.select(*[F.col(x) for x in staged.columns if x not in cols],
                        *[(F.col(x) + F.coalesce(F.col(f"_cy_{x}"), F.lit(0.0))).alias(x) for x in cols])
    return out.drop(c).select(*df.columns)


def sym_index(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def gram_columns(cols, prefix: str = "g"):
    """Spark aggregate expressions sum(z_i z_j), i <= j, for a small design (<= ~12 columns)."""
    return [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"{prefix}_{i}_{j}") for i, j in sym_index(len(cols))]


def unpack_gram(row_values: np.ndarray, m: int) -> np.ndarray:
    """(k, m(m+1)/2) packed upper triangles -> (k, m, m) symmetric matrices."""
    k = row_values.shape[0]
    out = np.zeros((k, m, m))
    iu = np.triu_indices(m)
    out[:, iu[0], iu[1]] = row_values
    out[:, iu[1], iu[0]] = row_values
    return out


def solve_batched(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Minimum-norm least-squares solutions of a batch of normal equations."""
    if ridge:
        a = a + ridge * np.eye(a.shape[-1])[None, :, :]
    return np.einsum("kij,kj->ki", np.linalg.pinv(a, hermitian=True), b)


def partial_gram(df: DataFrame, keys, cols, size: int | None = None, t: str = "t") -> DataFrame:
    """Long Gram (keys, i, j, v) of the design ``cols`` summed over rows with no NULL.

    Per (keys, chunk of the position ``t``) an Arrow grouped map forms X^T X of
    at most ``size`` rows, the same rows whenever a task is run again; the upper triangles are added by a grouped sum on (keys, i, j).
    Suits wide designs (tens of columns) where one Spark sum per entry would be
    too many aggregates.
    """
    keys, cols = list(keys), list(cols)
    size = min(size or chunk_rows(df.sparkSession), 1 << 15)
    staged = df.select(*keys, *cols, chunk_of(t, size).alias("_gc"))
    m = len(cols)
    iu = np.triu_indices(m)
    schema = ", ".join(key_schema(df, keys) + ["i long", "j long", "v double"])

    def per_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[cols].to_numpy(dtype=np.float64)
        x = x[~np.isnan(x).any(axis=1)]
        g = x.T @ x
        out = pd.DataFrame({"i": iu[0].astype("int64"), "j": iu[1].astype("int64"), "v": g[iu]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    part = staged.groupBy(*keys, "_gc").applyInPandas(per_chunk, schema)
    return part.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
