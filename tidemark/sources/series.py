"""Series readers and adapters."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import normal_noise, slot_of
from tidemark.operators.indexing import dense_index
from tidemark.session import chunk_rows

SERIES_SCHEMA = "series_id string, t bigint, ts timestamp_ntz, y double"
COMPONENTS_SCHEMA = "series_id string, t bigint, component string, k bigint, value double"

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def pick_value_col(df: DataFrame, name: str | None = None) -> str:
    """The named value column, else the first numeric one (A3)."""
    if name is not None:
        if name not in df.columns:
            raise ValueError(f"value column {name!r} not found in {df.columns}")
        return name
    for col, dtype in df.dtypes:
        if dtype in NUMERIC or dtype.startswith("decimal"):
            return col
    raise ValueError("no numeric column to use as series value")


def read_series(spark: SparkSession, path: str, value_col: str | None = None,
                ts_col: str | None = None, series_id: str | None = None,
                fmt: str = "csv") -> DataFrame:
    """One series from a header CSV (or parquet) file, row order as stored (A1).

    ``t`` is the row position; it is taken from the scan's file offset order and
    renumbered densely, so no single task has to hold the file.
    """
    return read_series_batch(spark, path, value_col=value_col, ts_col=ts_col, fmt=fmt,
                             fixed_id=series_id)


def _csv_headers(spark: SparkSession, paths) -> list[tuple[str, tuple[str, ...]]]:
    """(path, column names) of every CSV file: its first line, without the byte
    order mark that some writers put before it.  One partially aggregated scan;
    the result has a row per file."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i"), "value").where(F.col("at") == 0)
    found = lines.groupBy("path").agg(F.min_by("value", "i").alias("header")).collect()
    return [(r["path"], tuple(next(csv.reader([r["header"].lstrip("\ufeff")]), ()))) for r in
            sorted(found, key=lambda r: r["path"])]


def _groups(spark: SparkSession, paths, value_col, ts_col, fmt):
    """(loaded files of one layout, their value column or the reason there is none)."""
    if fmt != "csv":
        frames = [spark.read.format(fmt).load(paths)]
    else:
        by_header: dict[tuple[str, ...], list[str]] = {}
        for path, header in _csv_headers(spark, paths):
            by_header.setdefault(header, []).append(path)
        frames = []
        for header, files in by_header.items():
            names = [f"_{k}" for k in range(len(header))]
            schema = ", ".join(f"{n} string" for n in names)
            if value_col is None:  # the first numeric column is wanted: types have to be known
                kinds = spark.read.option("header", True).option("inferSchema", True).csv(files).dtypes
                schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, kinds, strict=True))
            meta = ["_metadata.file_name", "_metadata.file_block_start"]
            raw = spark.read.option("header", True).schema(schema).csv(files)
            frames.append(raw.select(*[F.col(n).alias(h) for n, h in zip(names, header, strict=True)],
                                     *[F.col(c).alias("_" + c.split(".")[1]) for c in meta]))
    for df in frames:
        if fmt != "csv":
            df = df.select("*", F.col("_metadata.file_name").alias("_file_name"),
                           F.col("_metadata.file_block_start").alias("_file_block_start"))
        try:
            value = pick_value_col(df.drop("_file_name", "_file_block_start"), value_col)
            if ts_col and ts_col not in df.columns:
                raise ValueError(f"timestamp column {ts_col!r} not found in {df.columns}")
            yield df, value, None
        except ValueError as why:
            yield df, None, str(why)


def _file_id(fixed_id: str | None) -> Column:
    return F.lit(fixed_id) if fixed_id else F.regexp_replace(F.col("_file_name"), r"\.[^.]*$", "")


def read_series_batch(spark: SparkSession, paths, value_col: str | None = None,
                      ts_col: str | None = None, fmt: str = "csv",
                      fixed_id: str | None = None) -> DataFrame:
    """Every file of a folder/glob as its own series, id = file base name (A2).

    Columns are found by each file's own header; files with the same header are
    one scan.  Files without the value (or timestamp) column, and rows without
    a timestamp where ``ts_col`` names one, are left out here and reported by
    ``batch_file_status``.  Row order inside a file is the timestamp's when
    given (ties as stored), else the stored one; ``t`` counts from 0.
    """
    parts, missing = [], []
    for df, value, why in _groups(spark, paths, value_col, ts_col, fmt):
        if value is None:
            missing.append(why)
            continue
        parts.append(df.select(
            _file_id(fixed_id).alias("series_id"),
            (F.col(f"`{ts_col}`").cast("timestamp_ntz") if ts_col else F.lit(None).cast("timestamp_ntz")).alias("ts"),
            F.col(f"`{value}`").cast("double").alias("y"),
            F.col("_file_block_start").alias("_blk"),
            F.monotonically_increasing_id().alias("_pos"),
        ))
    if not parts:
        raise ValueError("; ".join(missing) or f"no files at {paths}")
    ordered = reduce(DataFrame.unionByName, parts)
    if ts_col:
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        ordered = ordered.where(F.col("ts").isNotNull()).withColumn("_ord", micros)
        # blocks of equal time spans, as many as the rows ask for
        span = ordered.groupBy("series_id").agg(
            F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi"),
            F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows(spark))).alias("_cuts"))
        ordered = ordered.join(span, "series_id")
        width = (F.col("_hi") - F.col("_lo") + 1) / F.col("_cuts")
        block = F.floor((F.col("_ord") - F.col("_lo")) / width).cast("long")
        out = dense_index(ordered, ["series_id"], order=["_ord", "_blk", "_pos"], idx="t", count="_len", block=block)
    else:
        # Stored order: splits of a file are ranked by their start offset (a
        # tiny table: one row per split); inside a split the record number of
        # monotonically_increasing_id (its low 33 bits) keeps the file order.
        splits = ordered.select("series_id", "_blk").distinct().withColumn(
            "_rank", F.dense_rank().over(Window.partitionBy("series_id").orderBy("_blk")) - 1)
        ordered = ordered.join(splits, on=["series_id", "_blk"]).withColumn(
            "_ord", (F.col("_rank").cast("long") * F.lit(1 << 33)
                     + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
        out = dense_index(ordered, ["series_id"], order="_ord", idx="t", count="_len")
    return out.select("series_id", "t", "ts", "y")


def batch_file_status(spark: SparkSession, paths, value_col: str | None = None, ts_col: str | None = None,
                      fmt: str = "csv", fixed_id: str | None = None) -> DataFrame:
    """(series_id, status, error_message, n_rows, n_without_ts) per file of a batch (A2).

    status is ``Error`` for a file without the value or timestamp column."""
    parts = []
    for df, _, why in _groups(spark, paths, value_col, ts_col, fmt):
        lost = F.col(f"`{ts_col}`").cast("timestamp_ntz").isNull() if ts_col and ts_col in df.columns else F.lit(False)
        parts.append(df.groupBy(_file_id(fixed_id).alias("series_id")).agg(
            F.lit("Success" if why is None else "Error").alias("status"),
            F.lit(why).cast("string").alias("error_message"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(lost).alias("n_without_ts")))
    return reduce(DataFrame.unionByName, parts)


def clean_series(df: DataFrame, min_len: int = 0, keys=("series_id",)) -> DataFrame:
    """Drop NULL/NaN values, renumber ``t`` densely, keep series with >= min_len rows (A4)."""
    keys = list(keys)
    kept = df.where(F.col("y").isNotNull() & ~F.isnan("y"))
    out = dense_index(kept, keys, order="t", idx="_t", count="_len")
    out = out.where(F.col("_len") >= F.lit(min_len))
    return out.drop("t").withColumnRenamed("_t", "t").drop("_len").select(*df.columns)


def regular_grid(events: DataFrame, series_col: str, ts_col: str, value_col: str,
                 minutes: int = 15, fill: float | None = 0.0, by_day: bool = False,
                 block: int = 1 << 16) -> DataFrame:
    """Bucket irregular events per series onto a regular clock (A10).

    Slots run from each series' first to last bucket; empty slots get ``fill``
    (or stay NULL when ``fill`` is None).  The grid is generated in blocks of
    ``block`` slots that are spread over tasks before the second explode, and
    merged with the events by one aggregation (events are partially
    aggregated before the shuffle).
    """
    slot = F.unix_date(F.col(ts_col).cast("date")).cast("long") if by_day else slot_of(F.col(ts_col), minutes)
    ev = events.where(F.col(ts_col).isNotNull() & F.col(series_col).isNotNull()).select(
        F.col(series_col).cast("string").alias("series_id"),
        slot.alias("slot"),
        F.col(value_col).cast("double").alias("v"),
    )
    bounds = ev.groupBy("series_id").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    blocks = bounds.select(
        "series_id", "lo", "hi",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / block).cast("long"))).alias("b"),
    ).repartition("series_id", "b")
    grid = blocks.select(
        "series_id",
        F.explode(
            F.sequence(
                F.col("lo") + F.col("b") * block,
                F.least(F.col("hi"), F.col("lo") + (F.col("b") + 1) * block - 1),
            )
        ).alias("slot"),
        "lo",
    ).select("series_id", "slot", (F.col("slot") - F.col("lo")).alias("t"),
             F.lit(None).cast("double").alias("v"), F.lit(1).alias("g"))
    obs = ev.select("series_id", "slot", F.lit(None).cast("long").alias("t"), "v", F.lit(0).alias("g"))
    merged = grid.unionByName(obs).groupBy("series_id", "slot").agg(
        F.max("t").alias("t"), F.sum("v").alias("v"), F.max("g").alias("g")
    ).where(F.col("g") == 1)
    y = F.coalesce(F.col("v"), F.lit(fill)) if fill is not None else F.col("v")
    if by_day:
        ts = F.timestamp_seconds(F.col("slot") * 86400)
    else:
        ts = F.timestamp_seconds(F.col("slot") * (minutes * 60))
    return merged.select(
        "series_id", F.col("t").cast("long").alias("t"),
        ts.cast("timestamp_ntz").alias("ts"), (y + F.lit(0.0)).alias("y")
    )


def components_to_wide(components: DataFrame, keys=("series_id", "t"), names=None) -> DataFrame:
    """Long components -> one column per component name.

    ``names``: the component names; when not given, a distinct on the name
    column reads them (a small list, one per mode).
    """
    names = names or [r[0] for r in components.select("component").distinct().orderBy("component").collect()]
    return components.groupBy(*keys).pivot("component", names).agg(F.first("value"))


def components_to_long(wide: DataFrame, keys=("series_id", "t"), prefix: str = "IMF_",
                       residual: str | None = "residual") -> DataFrame:
    """Wide component columns -> canonical long table with ordinal ``k``."""
    modes = sorted((c for c in wide.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    cols = modes + ([residual] if residual and residual in wide.columns else [])
    long = wide.unpivot(list(keys), cols, "component", "value")
    order = {c: i + 1 for i, c in enumerate(cols)}
    k = reduce(lambda acc, kv: acc.when(F.col("component") == kv[0], F.lit(kv[1])),
               list(order.items())[1:], F.when(F.col("component") == cols[0], F.lit(1)))
    return long.withColumn("k", k.cast("long")).select(*keys, "component", "k", "value")


def select_by_prefix(df: DataFrame, prefix: str = "IMF_", extra=("residual",)) -> list[str]:
    """Columns starting with ``prefix`` plus present optional extras (B1)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return cols + [c for c in extra if c in df.columns]


def row_sum_target(df: DataFrame, cols, name: str = "sum") -> DataFrame:
    """Row-wise sum of columns, NULL treated as 0 (B2)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    return df.withColumn(name, total)


def synthetic_components(spark: SparkSession, n_series: int = 1, n: int = 365, k: int = 5,
                         seed: int = 42, start: str = "2023-01-01") -> DataFrame:
    """Daily wide table: IMF_1..k ~ N(50,10), residual ~ N(30,5) (A5).

    Values are hash-seeded per (seed, series, t, column), so they do not depend
    on partitioning.  Test helper; no registered query depends on it.
    """
    base = spark.range(n_series * n).select(
        (F.col("id") / n).cast("long").cast("string").alias("series_id"),
        (F.col("id") % n).alias("t"),
    )
    base = base.withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("t").cast("int")))
    cols = [
        (50 + 10 * normal_noise(F.lit(seed), F.col("series_id"), F.col("t"), F.lit(f"IMF_{i}"))).alias(f"IMF_{i}")
        for i in range(1, k + 1)
    ]
    cols.append((30 + 5 * normal_noise(F.lit(seed), F.col("series_id"), F.col("t"), F.lit("residual"))).alias("residual"))
    return base.select("series_id", "t", "date", *cols)
