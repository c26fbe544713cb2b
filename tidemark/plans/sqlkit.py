"""Oracle SQL building blocks (DuckDB dialect) for the fixtures of the catalog.

These strings restate the fixture definitions of ``tidemark.sources.fixtures``
declaratively so that an independent engine can check the Spark plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results are compared after rounding doubles to a 30-bit mantissa: the value
# is scaled by an exact power of two into [2^29, 2^30), rounded to an integer
# and scaled back, so decimal data never sits on a rounding midpoint and both
# engines round identically.  |x| < 1e-10 counts as 0 (float residue of sums
# that cancel); -0.0 becomes 0.0.
MANTISSA_BITS = 29
ZERO_BELOW = 1e-10


def fix_col(c: Column) -> Column:
    e = F.lit(MANTISSA_BITS) - F.floor(F.log2(F.abs(c)))
    scale = F.pow(F.lit(2.0), e)
    rounded = F.round(c * scale, 0) / scale
    return (F.when(c.isNull() | F.isnan(c), c)
            .when(F.abs(c) < F.lit(ZERO_BELOW), F.lit(0.0))
            .when(F.abs(c) == F.lit(float("inf")), c)
            .otherwise(rounded) + F.lit(0.0))


def fix_doubles(df: DataFrame, names) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if f.name in names and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(fix_col(F.col(f.name).cast("double")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def fix_sql(col: str) -> str:
    e = f"({MANTISSA_BITS} - floor(log2(abs({col}))))"
    return (f"(CASE WHEN {col} IS NULL OR isnan({col}) THEN {col} WHEN abs({col}) < {ZERO_BELOW!r} THEN 0.0 "
            f"WHEN isinf({col}) THEN {col} ELSE round({col} * pow(2.0, {e}), 0) / pow(2.0, {e}) END + 0.0)")


def wrap(sql: str, doubles) -> str:
    """Apply the rounding to the named double columns of a query's result."""
    if not doubles:
        return sql
    repl = ", ".join(f"{fix_sql(c)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


GRID = """
ev AS (
  SELECT event_type AS series_id, epoch_us(CAST(ts AS TIMESTAMP)) // 900000000 AS slot, value AS v
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
ev_bounds AS (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM ev GROUP BY series_id),
ev_slots AS (SELECT series_id, unnest(range(lo, hi + 1)) AS slot, lo FROM ev_bounds),
ev_sums AS (SELECT series_id, slot, sum(v) AS v FROM ev GROUP BY series_id, slot),
events_raw AS (
  SELECT g.series_id, CAST(g.slot - g.lo AS BIGINT) AS t, make_timestamp(g.slot * 900000000) AS ts,
         CAST(s.v AS DOUBLE) + 0.0 AS y
  FROM ev_slots g LEFT JOIN ev_sums s ON g.series_id = s.series_id AND g.slot = s.slot),
events_grid AS (SELECT series_id, t, ts, coalesce(y, 0.0) + 0.0 AS y FROM events_raw)"""

SEASONAL = """
events_seasonal AS (
  SELECT series_id, t, ts, y + 400.0 * sin(2 * pi() * (t % 96) / 96) AS y FROM events_grid)"""

WALK = """
events_walk AS (
  SELECT series_id, t, ts,
         sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
  FROM events_grid)"""

COMPONENTS = """
ev_bands AS (
  SELECT series_id, t, y,
         avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS ms,
         avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS ml
  FROM events_grid),
events_components AS (
  SELECT series_id, t, 'IMF_1' AS component, CAST(1 AS BIGINT) AS k, y - ms AS value FROM ev_bands
  UNION ALL SELECT series_id, t, 'IMF_2', CAST(2 AS BIGINT), ms - ml FROM ev_bands
  UNION ALL SELECT series_id, t, 'residual', CAST(3 AS BIGINT), ml FROM ev_bands)"""

ORDERS = """
od AS (
  SELECT o_orderpriority AS series_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS slot,
         o_totalprice AS v
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL),
od_bounds AS (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM od GROUP BY series_id),
od_slots AS (SELECT series_id, unnest(range(lo, hi + 1)) AS slot, lo FROM od_bounds),
od_sums AS (SELECT series_id, slot, sum(v) AS v FROM od GROUP BY series_id, slot),
orders_daily AS (
  SELECT g.series_id, CAST(g.slot - g.lo AS BIGINT) AS t, make_timestamp(g.slot * 86400000000) AS ts,
         coalesce(CAST(s.v AS DOUBLE), 0.0) + 0.0 AS y
  FROM od_slots g LEFT JOIN od_sums s ON g.series_id = s.series_id AND g.slot = s.slot)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks) + "\n"


def metrics_sql(src: str, keys: str) -> str:
    """n, rmse, mae, r2, mape, f24 of (y_true, y_pred) grouped by keys."""
    return f"""
SELECT {keys}, CAST(count(*) AS BIGINT) AS n,
  sqrt(avg(pow(y_pred - y_true, 2))) AS rmse,
  avg(abs(y_pred - y_true)) AS mae,
  CASE WHEN count(*) * var_pop(y_true) > 0 THEN 1 - sum(pow(y_pred - y_true, 2)) / (count(*) * var_pop(y_true))
       WHEN sum(pow(y_pred - y_true, 2)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
  avg(abs((y_pred - y_true) / (y_true + 1e-8))) * 100 AS mape,
  (avg(pow(y_pred - y_true, 2)) + avg(abs(y_pred - y_true)) + avg(abs(y_pred - y_true) / (abs(y_true) + 1e-10))) / 3 AS f24
FROM {src} GROUP BY {keys}"""


METRIC_COLS = ["rmse", "mae", "r2", "mape", "f24"]
