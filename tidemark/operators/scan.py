"""Linear recurrences as chunked window scans (section 4.3 of the design).

``s_i = d * s_{i-1} + b_i`` (``s_{-1} = 0``) is an affine, hence associative,
recurrence.  It is evaluated without ever ordering a whole series in one task:

1. rows are cut into chunks of ``C`` consecutive indices; inside a chunk
   ``loc_p = d^(p-m) * sum_{j<=p} b_j d^(m-j)`` (m = C/2) is a plain
   running-sum window over ``(keys, chunk)`` (``C`` is chosen so
   ``d^(-C/2)`` stays finite), or, when
   ``d`` is tiny, ``loc_p = sum_k d^k b_{p-k}`` from ``C`` lags;
2. the chunk ends ``L_c`` obey the same recurrence with decay ``d^C``; that
   much smaller table is scanned by the same function (recursively);
3. ``s = loc + d^{p+1} * carry`` where carry is the scanned value of the
   previous chunk (an equi-join on ``(keys, chunk)``).

The decay may be a column (one value per key group, e.g. per candidate alpha)
as long as ``decay_min`` bounds it from below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import chunk_rows

POLY_CHUNK = 16
# keep d^-p * b finite for |b| up to ~1e58
EXP_BUDGET = 250.0


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _chunk_size(dmin: float, cap: int) -> tuple[int, str]:
    if dmin >= 1.0:
        return cap, "pow"
    if dmin <= 0.0:
        return POLY_CHUNK, "poly"
    # exponents run from -C/2 to +C/2 around the chunk middle
    c = int(2 * EXP_BUDGET / abs(math.log10(dmin)))
    if c >= POLY_CHUNK:
        return max(2, min(cap, c)), "pow"
    return POLY_CHUNK, "poly"


def max_group_length(df: DataFrame, keys, idx: str) -> int:
    """Largest ``max(idx)+1`` over key groups: one small aggregate, one scalar to the driver."""
    row = df.groupBy(*keys).agg(F.max(idx).alias("_m")).agg(F.max("_m")).first()
    return 0 if row is None or row[0] is None else int(row[0]) + 1


def affine_scan(df: DataFrame, keys, idx: str, b: Column, decay, out: str,
                decay_min: float | None = None, max_len: int | None = None,
                chunk: int | None = None) -> DataFrame:
    """Append column ``out`` = s_idx of ``s = decay * s_prev + b`` per key group.

    ``idx`` must be the contiguous 0-based index inside each key group.
    """
    keys = list(keys)
    if decay_min is None:
        if isinstance(decay, Column):
            raise ValueError("decay_min is required when decay is a column")
        decay_min = float(decay)
    cap = chunk or chunk_rows(df.sparkSession)
    d = _lit(decay)
    tmp = f"_b_{out}"
    frame = df.withColumn(tmp, b.cast("double"))
    size, how = _chunk_size(float(decay_min), cap)
    single_chunk = max_len is not None and max_len <= size
    if not single_chunk and not isinstance(decay, Column) and how == "pow" and float(decay) ** size == 0.0:
        # d^C underflows: the carry into a chunk is exactly the previous chunk's
        # end, so one shifted join finishes the scan (no length probe, no recursion)
        return _scan_one_carry(frame, keys, idx, tmp, d, size, out).drop(tmp)
    if max_len is None:
        max_len = max_group_length(df, keys, idx)
    return _scan(frame, keys, idx, tmp, d, float(decay_min), max_len, cap, out).drop(tmp)


def _scan_one_carry(df: DataFrame, keys, idx: str, b: str, d: Column, size: int, out: str) -> DataFrame:
    c_col, p_col, loc = "_c0", "_p0", "_loc0"
    staged = df.withColumn(c_col, F.floor(F.col(idx) / F.lit(size)).cast("long")).withColumn(
        p_col, F.col(idx) - F.col(c_col) * F.lit(size))
    w = Window.partitionBy(*keys, c_col).orderBy(p_col)
    mid = F.lit(float(size // 2))
    prior = F.sum(F.col(b) * F.pow(d, mid - F.col(p_col))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    staged = staged.withColumn(loc, F.col(b) + F.coalesce(F.pow(d, F.col(p_col) - mid) * prior, F.lit(0.0)))
    ends = staged.groupBy(*keys, c_col).agg(F.max_by(F.col(loc), F.col(p_col)).alias("_end"))
    carry = ends.select(*keys, (F.col(c_col) + 1).alias(c_col), F.col("_end").alias("_carry0"))
    joined = staged.join(carry, on=[*keys, c_col], how="left")
    s = F.col(loc) + F.pow(d, F.col(p_col) + 1) * F.coalesce(F.col("_carry0"), F.lit(0.0))
    return joined.withColumn(out, s).drop(c_col, p_col, loc, "_carry0")


def _scan(df: DataFrame, keys, idx: str, b: str, d: Column, dmin: float, n_max: int,
          cap: int, out: str, level: int = 0) -> DataFrame:
    size, how = _chunk_size(dmin, cap)
    c_col, p_col, loc = f"_c{level}", f"_p{level}", f"_loc{level}"
    staged = df.withColumn(c_col, F.floor(F.col(idx) / F.lit(size)).cast("long")).withColumn(
        p_col, F.col(idx) - F.col(c_col) * F.lit(size)
    )
    w = Window.partitionBy(*keys, c_col).orderBy(p_col)
    if how == "pow":
        mid = F.lit(float(size // 2))
        # earlier terms through centred powers; the current term added exactly
        prior = F.sum(F.col(b) * F.pow(d, mid - F.col(p_col))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        staged = staged.withColumn(loc, F.col(b) + F.coalesce(F.pow(d, F.col(p_col) - mid) * prior, F.lit(0.0)))
    else:
        terms = [F.col(b)] + [
            F.coalesce(F.pow(d, F.lit(float(k))) * F.lag(F.col(b), k).over(w), F.lit(0.0))
            for k in range(1, size)
        ]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        staged = staged.withColumn(loc, total)
    if n_max <= size:
        return staged.withColumn(out, F.col(loc)).drop(c_col, p_col, loc)

    # chunk ends, one row per (keys, chunk); the same recurrence with decay d^size
    ends = staged.groupBy(*keys, c_col).agg(
        F.max_by(F.col(loc), F.col(p_col)).alias("_end"),
        F.first(d).alias("_d"),
    )
    dn = F.pow(F.col("_d"), F.lit(float(size)))
    dmin_next = 0.0 if dmin <= 0 else dmin ** size
    if dmin_next < 1e-300:
        dmin_next = 0.0
    inner, carry_col = f"_s{level + 1}", f"_carry{level}"
    scanned = _scan(
        ends.withColumnRenamed(c_col, "_ci"), keys, "_ci", "_end", dn, dmin_next,
        -(-n_max // size), cap, inner, level + 1,
    )
    carry = scanned.select(*keys, (F.col("_ci") + 1).alias(c_col), F.col(inner).alias(carry_col))
    joined = staged.join(carry, on=[*keys, c_col], how="left")
    s = F.col(loc) + F.pow(d, F.col(p_col) + 1) * F.coalesce(F.col(carry_col), F.lit(0.0))
    return joined.withColumn(out, s).drop(c_col, p_col, loc, carry_col)


def running_sum(df: DataFrame, keys, idx: str, value: Column, out: str, **kw) -> DataFrame:
    """Cumulative sum per key group (decay 1), chunked like every other scan."""
    return affine_scan(df, keys, idx, value, 1.0, out, **kw)
