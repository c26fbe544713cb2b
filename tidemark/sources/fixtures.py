"""Series derived from the driver tables (FIXTURES section 3).

``events_grid``   per event_type, 15-minute slots, sum(value), empty slots 0
``events_raw``    the same grid with empty slots left NULL (a raw series)
``events_seasonal`` grid + 400 sin(2 pi (t % 96) / 96)
``events_walk``   running sum of the grid per series
``events_components`` three rolling-mean bands that sum to y
``orders_daily``  per o_orderpriority, day, sum(o_totalprice), empty days 0
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.indexing import chunk_window, with_halo
from tidemark.operators.scan import running_sum
from tidemark.sources.series import regular_grid

# fixed values of the fixtures
SLOTS_PER_DAY = 96
SEASONAL_AMPLITUDE = 400.0
BAND_SHORT = 12
BAND_LONG = 96


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return regular_grid(ev, "event_type", "ts", "value", minutes=15, fill=0.0)


def events_grid_minutes(spark: SparkSession, sf_dir: str, minutes: int = 1) -> DataFrame:
    """The event grid at a finer clock (longer series from the same table)."""
    ev = table(spark, sf_dir, "events")
    return regular_grid(ev, "event_type", "ts", "value", minutes=minutes, fill=0.0)


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return regular_grid(ev, "event_type", "ts", "value", minutes=15, fill=None)


def events_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events_grid(spark, sf_dir)
    wave = F.lit(SEASONAL_AMPLITUDE) * F.sin(
        F.lit(2 * math.pi) * F.pmod(F.col("t"), F.lit(SLOTS_PER_DAY)) / F.lit(SLOTS_PER_DAY)
    )
    return g.withColumn("y", F.col("y") + wave)


def events_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events_grid(spark, sf_dir)
    return running_sum(g, ["series_id"], "t", F.col("y"), "_walk").withColumn("y", F.col("_walk")).drop("_walk")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return regular_grid(o, "o_orderpriority", "o_orderdate", "o_totalprice", fill=0.0, by_day=True)


def rolling_bands(series: DataFrame, short: int = BAND_SHORT, long: int = BAND_LONG) -> DataFrame:
    """Long components: IMF_1 = y - mean_short, IMF_2 = mean_short - mean_long, residual = mean_long.

    Trailing means over partial frames at the start, so the three sum to y
    exactly and no row is NULL.
    """
    framed = with_halo(series, before=long - 1)
    w = chunk_window(["series_id"])
    ms = F.avg("y").over(w.rowsBetween(-(short - 1), 0))
    ml = F.avg("y").over(w.rowsBetween(-(long - 1), 0))
    bands = framed.select("series_id", "t", "y", "_home", ms.alias("ms"), ml.alias("ml")).where("_home")
    comps = F.array(
        F.struct(F.lit("IMF_1").alias("component"), F.lit(1).cast("long").alias("k"), (F.col("y") - F.col("ms")).alias("value")),
        F.struct(F.lit("IMF_2").alias("component"), F.lit(2).cast("long").alias("k"), (F.col("ms") - F.col("ml")).alias("value")),
        F.struct(F.lit("residual").alias("component"), F.lit(3).cast("long").alias("k"), F.col("ml").alias("value")),
    )
    return bands.select("series_id", "t", F.inline(comps))


def events_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_bands(events_grid(spark, sf_dir))
