"""Leakage-free temporal splits and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indexing import dense_index


def temporal_split(df: DataFrame, train: float = 0.6, val: float = 0.2, keys=("series_id",), t: str = "t",
                   out: str = "split") -> DataFrame:
    """Ordered train/val/test per series; bounds int(n*train), int(n*(train+val)).

    ``n`` counts the rows present (after NULL drops); positions come from a
    chunked dense index, not from a whole-series window.
    """
    keys = list(keys)
    staged = dense_index(df, keys, order=t, idx="_i", count="_n")
    train_end = F.floor(F.col("_n") * F.lit(float(train)))
    val_end = F.floor(F.col("_n") * F.lit(float(train + val)))
    split = F.when(F.col("_i") < train_end, "train").when(F.col("_i") < val_end, "val").otherwise("test")
    return staged.withColumn(out, split).drop("_i", "_n")


def holdout_split(df: DataFrame, train: float = 0.8, keys=("series_id",), t: str = "t", out: str = "split") -> DataFrame:
    """Ordered 80/20 split of window samples."""
    keys = list(keys)
    staged = dense_index(df, keys, order=t, idx="_i", count="_n")
    split = F.when(F.col("_i") < F.floor(F.col("_n") * F.lit(float(train))), "train").otherwise("test")
    return staged.withColumn(out, split).drop("_i", "_n")


def gapped_cv_split(df: DataFrame, n_splits: int = 5, gap: int = 8, keys=("series_id",), t: str = "t") -> DataFrame:
    """Expanding folds with a gap (T3): test size n // (n_splits+1).

    Fold f (1..n_splits) tests rows [n-(n_splits-f+1)*size, +size) and trains on
    rows before test_start - gap.  Emits (keys, t, fold, role); rows outside a
    fold (the gap) are absent.
    """
    keys = list(keys)
    staged = dense_index(df.select(*keys, t), keys, order=t, idx="_i", count="_n")
    size = F.floor(F.col("_n") / (n_splits + 1))
    folds = staged.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_splits).cast("long"))))
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold") + 1) * size
    role = F.when(F.col("_i") < start - gap, "train").when(
        (F.col("_i") >= start) & (F.col("_i") < start + size), "test")
    return folds.withColumn("role", role).where(F.col("role").isNotNull() & (size > 0)).select(*keys, t, "fold", "role")


def minmax_fit(df: DataFrame, cols, keys=("series_id",), split_col: str | None = "split",
               fit_on: str = "train") -> DataFrame:
    """Per series min/max of each column on the fitting rows (T4).

    ``fit_on="all"`` reproduces fitting before the split.  One row per series.
    """
    keys = list(keys)
    src = df if fit_on == "all" or split_col is None else df.where(F.col(split_col) == fit_on)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    return src.groupBy(*keys).agg(*aggs)


def _range(c: str):
    r = F.col(f"_max_{c}") - F.col(f"_min_{c}")
    return F.when(r == 0, F.lit(1.0)).otherwise(r)


def minmax_scale(df: DataFrame, cols, keys=("series_id",), split_col: str | None = "split", fit_on: str = "train",
                 bounds: DataFrame | None = None, suffix: str = "_sc") -> DataFrame:
    """(x - min) / (max - min) per series, constant columns map to 0 (T4)."""
    keys = list(keys)
    bounds = bounds if bounds is not None else minmax_fit(df, cols, keys, split_col, fit_on)
    joined = df.join(bounds, on=keys, how="inner")
    out = joined.select(*df.columns, *[((F.col(c) - F.col(f"_min_{c}")) / _range(c)).alias(f"{c}{suffix}") for c in cols])
    return out


def minmax_inverse(df: DataFrame, bounds: DataFrame, pairs: dict[str, str], keys=("series_id",)) -> DataFrame:
    """Scale predictions back: x = s * (max - min) + min; pairs maps scaled column -> fitted column."""
    keys = list(keys)
    joined = df.join(bounds, on=keys, how="inner")
    extra = [(F.col(s) * _range(c) + F.col(f"_min_{c}")).alias(f"{s}_inv") for s, c in pairs.items()]
    return joined.select(*df.columns, *extra)
