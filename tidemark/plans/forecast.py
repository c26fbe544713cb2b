"""Small reusable forecast flows used by the catalog and the pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import multistep_targets
from tidemark.operators.splits import temporal_split


def long_targets(df: DataFrame, steps: int = 3, value: str = "y", keys=("series_id",), t: str = "t",
                 extra=()) -> DataFrame:
    """(keys, t, extra..., step, y_true) from the wide y_step_h columns."""
    keys = list(keys)
    arr = F.array(*[F.col(f"{value}_step_{h}") for h in range(1, steps + 1)])
    return df.select(*keys, t, *extra, F.posexplode(arr).alias("_pos", "y_true")).withColumn(
        "step", (F.col("_pos") + 1).cast("long")).drop("_pos")


def persistence_forecasts(series: DataFrame, steps: int = 3, value: str = "y") -> DataFrame:
    """Persistence forecast y_hat(t+h) = y_t on every origin with complete truths,
    labelled with the ordered 60/20/20 split: (series_id, t, split, step, y_true, y_pred)."""
    tg = multistep_targets(series.select("series_id", "t", value), steps, value)
    sp = temporal_split(tg)
    return long_targets(sp, steps, value, extra=["split", value]).withColumnRenamed(value, "y_pred")
