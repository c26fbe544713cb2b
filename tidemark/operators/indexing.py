"""Position helpers that never put a whole series into one window task.

A window ``partitionBy(series_id).orderBy(t)`` moves every row of a series to
one task; one hot series (a third of all rows) would then be sorted by a single
core.  These helpers split a series into chunks of ``tidemark.chunk.rows``
rows, work per ``(series_id, chunk)`` and stitch chunks together through a
small per-chunk summary table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import chunk_rows


def chunk_of(t: str, size: int) -> Column:
    return F.floor(F.col(t) / F.lit(size)).cast("long")


def with_halo(df: DataFrame, before: int, after: int = 0, t: str = "t", size: int | None = None) -> DataFrame:
    """Add ``_c`` (chunk id) and ``_home`` (False for halo copies).

    Chunk c holds rows [cC, cC+C); its windows need rows back to cC-before and
    up to cC+C-1+after.  Row t is therefore copied into every chunk from
    floor((t-after)/C) to floor((t+before)/C), so a window over
    ``(series_id, _c)`` sees ``before`` rows back and ``after`` rows ahead
    across chunk borders (halos may be wider than a chunk).  ``t`` must be the
    contiguous row index.
    """
    size = size or chunk_rows(df.sparkSession)
    c = chunk_of(t, size)
    lo = F.greatest(F.floor((F.col(t) - F.lit(after)) / F.lit(size)).cast("long"), F.lit(0).cast("long"))
    hi = F.floor((F.col(t) + F.lit(before)) / F.lit(size)).cast("long")
    targets = F.sequence(lo, hi) if (before or after) else F.array(c)
    return (
        df.withColumn("_c0", c)
        .withColumn("_c", F.explode(targets))
        .withColumn("_home", F.col("_c") == F.col("_c0"))
        .drop("_c0")
    )


def chunk_window(keys, t: str = "t") -> Window:
    return Window.partitionBy(*keys, "_c").orderBy(t)


def dense_index(df: DataFrame, keys, order="t", size: int | None = None,
                idx: str = "_idx", count: str = "_n", block: Column | None = None) -> DataFrame:
    """0-based position ``idx`` of each row inside its key group and group size ``count``.

    ``order`` must be an integer column, unique within a group (or several
    columns with ``block``, a number that never falls along the order).  Rows
    are numbered per ``(keys, order div size)`` block; block offsets come from
    a running sum over the per-block counts (one row per block).
    """
    keys = list(keys)
    size = size or chunk_rows(df.sparkSession)
    blocked = df.withColumn("_b", chunk_of(order, size) if block is None else block)
    order = [order] if isinstance(order, str) else list(order)
    counts = blocked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wk = Window.partitionBy(*keys)
    counts = counts.select(
        *keys,
        "_b",
        (F.sum("_bn").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
        F.sum("_bn").over(wk).alias(count),
    ).fillna(0, subset=["_off"])
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return (
        blocked.withColumn("_loc", local)
        .join(counts, on=[*keys, "_b"], how="inner")
        .withColumn(idx, (F.col("_loc") + F.col("_off")).cast("long"))
        .withColumn(count, F.col(count).cast("long"))
        .drop("_b", "_loc", "_off")
    )


def series_length(df: DataFrame, keys=("series_id",), t: str = "t", name: str = "n") -> DataFrame:
    """One row per series with its length ``max(t) + 1`` (partial aggregation, no window)."""
    return df.groupBy(*keys).agg((F.max(t) + 1).cast("long").alias(name))


def key_schema(df: DataFrame, keys) -> list[str]:
    """DDL fragments ``name type`` of key columns, for Arrow UDF output schemas."""
    return [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
