"""Registered queries: a Spark plan per operator and, where SQL can say the
same thing, an equivalent DuckDB statement over the raw driver tables.

Every query reads the driver tables (``events``, ``orders``) and derives its
series from them, so its work grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import metrics as me
from tidemark.operators import smoothing as sm
from tidemark.operators import splits as sp
from tidemark.operators import transform as tr
from tidemark.plans import sqlkit as q
from tidemark.plans.forecast import persistence_forecasts
from tidemark.session import cut_lineage
from tidemark.sources import fixtures as fx
from tidemark.sources.series import clean_series

REGISTRY: dict[str, "Entry"] = {}


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query's rows; where a statement is compared, the computed sums it
        names (``doubles``) are rounded alike on both sides, nothing else is."""
        return q.fix_doubles(self.fn(spark, sf_dir), self.doubles if self.sql is not None else [])

    def oracle(self) -> str | None:
        return None if self.sql is None else q.wrap(self.sql, self.doubles)


def register(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        REGISTRY[name] = Entry(name, fn, sql, list(doubles))
        return fn
    return deco


G = q.GRID
PERSIST = """
tg AS (SELECT series_id, t, y, lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3
       FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY t)),
tk AS (SELECT * FROM tg WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i,
              count(*) OVER (PARTITION BY series_id) AS n FROM tk),
sp AS (SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split
       FROM ix),
pl AS (SELECT series_id, t, split, CAST(1 AS BIGINT) AS step, y1 AS y_true, y AS y_pred FROM sp
       UNION ALL SELECT series_id, t, split, CAST(2 AS BIGINT), y2, y FROM sp
       UNION ALL SELECT series_id, t, split, CAST(3 AS BIGINT), y3, y FROM sp)"""


def persist_cte(src: str) -> str:
    return PERSIST.replace("{src}", src)


# ---------------------------------------------------------------- flagship
@register("persistence_metrics",
          q.with_(G, persist_cte("events_grid")) + q.metrics_sql("pl", "series_id, split, step"),
          q.METRIC_COLS)
def persistence_metrics(spark, sf):
    """Grid -> 3-step targets -> ordered split -> persistence forecast -> M1-M5."""
    pf = persistence_forecasts(fx.events_grid(spark, sf))
    return me.forecast_metrics(pf, ["series_id", "split", "step"])


# ---------------------------------------------------------------- sources
@register("regular_grid", q.with_(G) + "SELECT series_id, t, ts, y FROM events_grid", ["y"])
def regular_grid(spark, sf):
    return fx.events_grid(spark, sf)


@register("orders_daily", q.with_(q.ORDERS) + "SELECT series_id, t, ts, y FROM orders_daily", ["y"])
def orders_daily(spark, sf):
    return fx.orders_daily(spark, sf)


@register("clean_series", q.with_(G, """
kept AS (SELECT series_id, t, ts, y FROM events_raw WHERE y IS NOT NULL AND NOT isnan(y)),
rn AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS BIGINT) AS t, ts, y,
              count(*) OVER (PARTITION BY series_id) AS n FROM kept)""") +
          "SELECT series_id, t, ts, y FROM rn WHERE n >= 100", ["y"])
def clean_series_q(spark, sf):
    return clean_series(fx.events_raw(spark, sf), min_len=100)


# ---------------------------------------------------------------- window features
LAG_SQL = ", ".join(f"lag(y, {k}) OVER w AS y_lag_{k}" for k in range(1, 9))
LAG_COLS = [f"y_lag_{k}" for k in range(1, 9)]
WIN = " WINDOW w AS (PARTITION BY series_id ORDER BY t)"


@register("lags", q.with_(G) + f"SELECT series_id, t, y, {LAG_SQL} FROM events_grid" + WIN, ["y", *LAG_COLS])
def lags_q(spark, sf):
    return fe.lags(fx.events_grid(spark, sf).select("series_id", "t", "y"), 8)


@register("multistep_targets", q.with_(G, """
tg AS (SELECT series_id, t, y, lead(y, 1) OVER w AS y_step_1, lead(y, 2) OVER w AS y_step_2,
              lead(y, 3) OVER w AS y_step_3 FROM events_grid WINDOW w AS (PARTITION BY series_id ORDER BY t))""") +
          "SELECT * FROM tg WHERE y_step_1 IS NOT NULL AND y_step_2 IS NOT NULL AND y_step_3 IS NOT NULL",
          ["y", "y_step_1", "y_step_2", "y_step_3"])
def multistep_targets_q(spark, sf):
    return fe.multistep_targets(fx.events_grid(spark, sf).select("series_id", "t", "y"), 3)


def _roll_sql(stat: str, fn: str) -> str:
    cols = []
    for w in (3, 6, 12):
        frame = f"(PARTITION BY series_id ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"CASE WHEN count(y) OVER {frame} = {w} THEN {fn}(y) OVER {frame} END AS y_roll_{stat}_{w}")
    return ", ".join(cols)


@register("rolling_mean", q.with_(G) + f"SELECT series_id, t, y, {_roll_sql('mean', 'avg')} FROM events_grid",
          ["y", "y_roll_mean_3", "y_roll_mean_6", "y_roll_mean_12"])
def rolling_mean_q(spark, sf):
    return fe.rolling(fx.events_grid(spark, sf).select("series_id", "t", "y"), stats=("mean",))


@register("rolling_std", q.with_(G) + f"SELECT series_id, t, y, {_roll_sql('std', 'stddev_samp')} FROM events_grid",
          ["y", "y_roll_std_3", "y_roll_std_6", "y_roll_std_12"])
def rolling_std_q(spark, sf):
    return fe.rolling(fx.events_grid(spark, sf).select("series_id", "t", "y"), stats=("std",))


@register("diffs", q.with_(G) + "SELECT series_id, t, y, y - lag(y, 1) OVER w AS y_diff_1, y - lag(y, 2) OVER w AS y_diff_2 "
          "FROM events_grid" + WIN, ["y", "y_diff_1", "y_diff_2"])
def diffs_q(spark, sf):
    return fe.diffs(fx.events_grid(spark, sf).select("series_id", "t", "y"))


def ewm_cte(src: str, span: float, name: str) -> str:
    """Recursive oracle of the bias-adjusted EWM: num_t = y_t + (1-a) num_{t-1}."""
    a = 2.0 / (span + 1.0)
    return f"""
{name}_rec AS (
  SELECT series_id, t, y, y AS num FROM {src} WHERE t = 0
  UNION ALL
  SELECT s.series_id, s.t, s.y, s.y + {1.0 - a!r} * r.num
  FROM {name}_rec r JOIN {src} s ON s.series_id = r.series_id AND s.t = r.t + 1),
{name} AS (SELECT series_id, t, y, num * {a!r} / (1 - pow({1.0 - a!r}, t + 1)) AS ewm FROM {name}_rec)"""


@register("ewm_span3", q.with_(G, ewm_cte("events_grid", 3, "e3")).replace("WITH ", "WITH RECURSIVE ", 1) +
          "SELECT series_id, t, y, ewm AS ewm_3 FROM e3", ["y", "ewm_3"])
def ewm3_q(spark, sf):
    return sm.ewm(fx.events_grid(spark, sf).select("series_id", "t", "y"), 3, out="ewm_3")


@register("ewm_span7", q.with_(G, ewm_cte("events_grid", 7, "e7")).replace("WITH ", "WITH RECURSIVE ", 1) +
          "SELECT series_id, t, y, ewm AS ewm_7 FROM e7", ["y", "ewm_7"])
def ewm7_q(spark, sf):
    return sm.ewm(fx.events_grid(spark, sf).select("series_id", "t", "y"), 7, out="ewm_7")


@register("slot_in_day", q.with_(G) +
          "SELECT series_id, t, CAST((epoch_us(CAST(ts AS TIMESTAMP)) // 900000000) % 96 AS BIGINT) AS slot_in_day "
          "FROM events_grid")
def slot_in_day_q(spark, sf):
    return fe.slot_in_day(fx.events_grid(spark, sf).select("series_id", "t", "ts"), ts="ts").drop("ts")


@register("daily_cycle", q.with_(G) +
          "SELECT series_id, t, CAST(t % 96 AS BIGINT) AS slot_in_day, sin(2 * pi() * (t % 96) / 96) AS sin_d, "
          "cos(2 * pi() * (t % 96) / 96) AS cos_d FROM events_grid", ["sin_d", "cos_d"])
def daily_cycle_q(spark, sf):
    return fe.daily_cycle(fe.slot_in_day(fx.events_grid(spark, sf).select("series_id", "t")))


@register("weekly_cycle", q.with_(G) +
          "SELECT series_id, t, sin(2 * pi() * t / 672) AS sin_w, cos(2 * pi() * t / 672) AS cos_w FROM events_grid",
          ["sin_w", "cos_w"])
def weekly_cycle_q(spark, sf):
    return fe.weekly_cycle(fx.events_grid(spark, sf).select("series_id", "t"))


_FEAT_DOUBLES = (["y", *LAG_COLS] + [f"y_roll_{s}_{w}" for w in (3, 6, 12) for s in ("mean", "std")] +
                 ["y_diff_1", "y_diff_2", "sin_d", "cos_d", "sin_w", "cos_w", "y_ewm_short", "y_ewm_long"])


@register("build_features", (q.with_(G, ewm_cte("events_grid", 3, "e3"), ewm_cte("events_grid", 7, "e7"))
                             .replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT g.series_id, g.t, g.y, {LAG_SQL.replace('lag(y', 'lag(g.y')},
  {_roll_sql('mean', 'avg').replace('(y)', '(g.y)')}, {_roll_sql('std', 'stddev_samp').replace('(y)', '(g.y)')},
  g.y - lag(g.y, 1) OVER w AS y_diff_1, g.y - lag(g.y, 2) OVER w AS y_diff_2,
  CAST(g.t % 96 AS BIGINT) AS slot_in_day, sin(2 * pi() * (g.t % 96) / 96) AS sin_d, cos(2 * pi() * (g.t % 96) / 96) AS cos_d,
  sin(2 * pi() * g.t / 672) AS sin_w, cos(2 * pi() * g.t / 672) AS cos_w,
  e3.ewm AS y_ewm_short, e7.ewm AS y_ewm_long
FROM events_grid g JOIN e3 ON g.series_id = e3.series_id AND g.t = e3.t
JOIN e7 ON g.series_id = e7.series_id AND g.t = e7.t
WINDOW w AS (PARTITION BY g.series_id ORDER BY g.t)""".replace("count(y)", "count(g.y)")
    .replace("PARTITION BY series_id ORDER BY t ROWS", "PARTITION BY g.series_id ORDER BY g.t ROWS")), _FEAT_DOUBLES)
def build_features_q(spark, sf):
    return fe.build_features(fx.events_grid(spark, sf).select("series_id", "t", "y"))


WIDE = """
wide AS (SELECT series_id, t,
  max(CASE WHEN component = 'IMF_1' THEN value END) AS IMF_1,
  max(CASE WHEN component = 'IMF_2' THEN value END) AS IMF_2,
  max(CASE WHEN component = 'residual' THEN value END) AS residual
  FROM events_components GROUP BY series_id, t)"""


@register("sequence_windows", q.with_(G, q.COMPONENTS, WIDE, """
sw AS (SELECT series_id, t,
  count(*) OVER f AS cnt,
  sum(IMF_1 + IMF_2 + residual) OVER f AS x_sum,
  first_value(IMF_1 + 2 * IMF_2 + 3 * residual) OVER f AS x_first,
  IMF_1 + 2 * IMF_2 + 3 * residual AS x_last,
  lead(IMF_1 + IMF_2 + residual, 1) OVER w AS y_1,
  lead(IMF_1 + IMF_2 + residual, 2) OVER w AS y_2,
  lead(IMF_1 + IMF_2 + residual, 3) OVER w AS y_3
  FROM wide WINDOW w AS (PARTITION BY series_id ORDER BY t),
  f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""") +
          "SELECT series_id, CAST(t - 29 AS BIGINT) AS sample, t, x_sum, x_first, x_last, y_1, y_2, y_3 FROM sw "
          "WHERE cnt = 30 AND y_3 IS NOT NULL", ["x_sum", "x_first", "x_last", "y_1", "y_2", "y_3"])
def sequence_windows_q(spark, sf):
    """Look-back windows of the three components; each sample reported by a digest
    (sum of all cells, weighted first and last rows) and its three targets."""
    from tidemark.sources.series import components_to_wide, row_sum_target
    wide = components_to_wide(fx.events_components(spark, sf))
    wide = row_sum_target(wide, ["IMF_1", "IMF_2", "residual"], "sum")
    sw = fe.sequence_windows(wide, ["IMF_1", "IMF_2", "residual"], 30, 3, "sum")
    digest_sum = F.aggregate(F.transform("x", lambda r: r[0] + r[1] + r[2]), F.lit(0.0), lambda a, b: a + b)
    first, last = F.col("x")[0], F.element_at("x", -1)
    return sw.select("series_id", "sample", "t", digest_sum.alias("x_sum"),
                     (first[0] + 2 * first[1] + 3 * first[2]).alias("x_first"),
                     (last[0] + 2 * last[1] + 3 * last[2]).alias("x_last"),
                     F.col("y_seq")[0].alias("y_1"), F.col("y_seq")[1].alias("y_2"), F.col("y_seq")[2].alias("y_3"))


@register("ar_design", q.with_(G) + f"SELECT * FROM (SELECT series_id, t, y, {LAG_SQL} FROM events_grid" + WIN +
          ") WHERE t >= 8", ["y", *LAG_COLS])
def ar_design_q(spark, sf):
    return fe.ar_design(fx.events_grid(spark, sf), 8)


# ---------------------------------------------------------------- smoothing
ALPHA = 0.3


def es_cte(src: str, alpha: float, name: str, idx: str = "t") -> str:
    """Recursive oracle of single and double smoothing along ``idx``."""
    a, d = alpha, 1.0 - alpha
    return f"""
{name} AS (
  SELECT series_id, {idx}, y, y AS s1, y AS s2 FROM {src} WHERE {idx} = 0
  UNION ALL
  SELECT g.series_id, g.{idx}, g.y, {a!r} * g.y + {d!r} * r.s1,
         {a!r} * ({a!r} * g.y + {d!r} * r.s1) + {d!r} * r.s2
  FROM {name} r JOIN {src} g ON g.series_id = r.series_id AND g.{idx} = r.{idx} + 1)"""


def rec(*blocks: str) -> str:
    return q.with_(*blocks).replace("WITH ", "WITH RECURSIVE ", 1)


@register("exp_smooth", rec(G, es_cte("events_grid", ALPHA, "es")) + "SELECT series_id, t, y, s1 AS s FROM es",
          ["y", "s"])
def exp_smooth_q(spark, sf):
    return sm.exp_smooth(fx.events_grid(spark, sf).select("series_id", "t", "y"), ALPHA, out="s")


@register("double_exp_smooth", rec(G, es_cte("events_grid", ALPHA, "es")) + "SELECT series_id, t, y, s2 FROM es",
          ["y", "s2"])
def double_exp_smooth_q(spark, sf):
    return sm.double_exp_smooth(fx.events_grid(spark, sf).select("series_id", "t", "y"), ALPHA, out="s2")


ZP = """
ev_len AS (SELECT series_id, max(t) + 1 AS n FROM events_grid GROUP BY series_id),
ev_rev AS (SELECT g.series_id, l.n - 1 - g.t AS r, g.t, g.y FROM events_grid g JOIN ev_len l USING (series_id)),"""


def _zp_sql(select: str) -> str:
    return rec(G, ZP.rstrip(","), es_cte("events_grid", ALPHA, "fw"), es_cte("ev_rev", ALPHA, "bw", "r")) + f"""
, zp AS (SELECT f.series_id, f.t, f.y, (f.s2 + b.s2) / 2 AS trend
       FROM fw f JOIN ev_len l ON f.series_id = l.series_id
       JOIN bw b ON b.series_id = f.series_id AND b.r = l.n - 1 - f.t)
{select}"""


@register("zero_phase_trend", _zp_sql("SELECT series_id, t, y, trend FROM zp"), ["y", "trend"])
def zero_phase_trend_q(spark, sf):
    return sm.zero_phase_trend(fx.events_grid(spark, sf).select("series_id", "t", "y"), ALPHA)


@register("detrend", _zp_sql("SELECT series_id, t, trend, y - trend AS residual FROM zp"), ["trend", "residual"])
def detrend_q(spark, sf):
    z = sm.zero_phase_trend(fx.events_grid(spark, sf).select("series_id", "t", "y"), ALPHA)
    return sm.detrend(z).select("series_id", "t", "trend", "residual")


N_ALPHA, ALPHA_LO = 20, 0.01
ALPHA_HI = sm.alpha_max(1.0)
ALPHA_STEP = (ALPHA_HI - ALPHA_LO) / (N_ALPHA - 1)
ALPHA_GRID_SQL = f"""
ids AS (SELECT DISTINCT event_type AS series_id FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
agrid AS (SELECT series_id, CAST(k AS BIGINT) AS alpha_idx, {ALPHA_LO!r} + k * {ALPHA_STEP!r} AS alpha
          FROM ids, range(0, {N_ALPHA}) AS r(k))"""


def alpha_grid(spark, sf) -> DataFrame:
    """(series_id, alpha_idx, alpha): the linspace(0.01, alpha_max, 20) grid per series."""
    ev = fx.table(spark, sf, "events").where("event_type IS NOT NULL AND ts IS NOT NULL")
    ids = ev.select(F.col("event_type").alias("series_id")).distinct()
    return ids.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_ALPHA - 1).cast("long"))).alias("alpha_idx")) \
        .withColumn("alpha", F.lit(ALPHA_LO) + F.col("alpha_idx") * F.lit(ALPHA_STEP))


@register("half_life", q.with_(ALPHA_GRID_SQL) +
          "SELECT series_id, alpha_idx, alpha, CASE WHEN alpha >= 0.999 THEN 'inf'::DOUBLE "
          "ELSE -ln(2) / ln(1 - alpha) END AS half_life FROM agrid", ["alpha", "half_life"])
def half_life_q(spark, sf):
    return sm.with_half_life(alpha_grid(spark, sf))


@register("alpha_grid_smooth", rec(G, ALPHA_GRID_SQL, f"""
ag AS (SELECT g.series_id, a.alpha_idx, a.alpha, g.t, g.y FROM events_grid g JOIN agrid a USING (series_id)),
ags AS (SELECT series_id, alpha_idx, alpha, t, y, y AS s FROM ag WHERE t = 0
  UNION ALL SELECT g.series_id, g.alpha_idx, g.alpha, g.t, g.y, g.alpha * g.y + (1 - g.alpha) * r.s
  FROM ags r JOIN ag g ON g.series_id = r.series_id AND g.alpha_idx = r.alpha_idx AND g.t = r.t + 1),
agl AS (SELECT *, lag(s, 1) OVER (PARTITION BY series_id, alpha_idx ORDER BY t) AS s_prev FROM ags)""") +
          "SELECT series_id, alpha_idx, alpha, sum(pow(y - s_prev, 2)) AS sse FROM agl GROUP BY series_id, alpha_idx, alpha",
          ["alpha", "sse"])
def alpha_grid_smooth_q(spark, sf):
    """One-step-ahead SSE of exponential smoothing for every (series, alpha) of the grid.

    The grid fans out by a generator (no join of series x alphas); alpha is a
    column, so all candidates run in the same scan."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    grid = g.select("series_id", "t", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_ALPHA - 1).cast("long"))).alias("alpha_idx"))
    grid = grid.withColumn("alpha", F.lit(ALPHA_LO) + F.col("alpha_idx") * F.lit(ALPHA_STEP))
    keys = ["series_id", "alpha_idx"]
    s = sm.exp_smooth(grid, F.col("alpha"), out="s", keys=keys, alpha_hi=ALPHA_HI)
    s = fe.windowed(s, lambda w: [F.lag("s", 1).over(w).alias("s_prev")], 1, 0, keys)
    return s.groupBy("series_id", "alpha_idx", "alpha").agg(F.sum(F.pow(F.col("y") - F.col("s_prev"), 2)).alias("sse"))


# ---------------------------------------------------------------- differencing and inversion
@register("seasonal_diff", q.with_(G, q.SEASONAL) +
          "SELECT series_id, t, y, y - lag(y, 96) OVER w AS y_seas FROM events_seasonal" + WIN, ["y", "y_seas"])
def seasonal_diff_q(spark, sf):
    return tr.seasonal_diff(fx.events_seasonal(spark, sf).select("series_id", "t", "y"))


@register("first_diff", q.with_(G, q.WALK) + "SELECT series_id, t, y, y - lag(y, 1) OVER w AS y_diff FROM events_walk" + WIN,
          ["y", "y_diff"])
def first_diff_q(spark, sf):
    return tr.first_diff(fx.events_walk(spark, sf).select("series_id", "t", "y"))


@register("autocorr", q.with_(G, q.SEASONAL, """
lagged AS (SELECT series_id, y, lag(y, 96) OVER (PARTITION BY series_id ORDER BY t) AS l FROM events_seasonal)""") +
          "SELECT series_id, corr(y, l) AS autocorr FROM lagged GROUP BY series_id", ["autocorr"])
def autocorr_q(spark, sf):
    return tr.autocorr(fx.events_seasonal(spark, sf).select("series_id", "t", "y"))


@register("trend_slope_test", q.with_(G, q.WALK, """
ts_stats AS (SELECT series_id, regr_slope(y, CAST(t AS DOUBLE)) AS slope, stddev_pop(y) AS std FROM events_walk GROUP BY series_id)""") +
          "SELECT series_id, slope, std, coalesce(abs(slope) > 0.02 * (std + 1e-6), false) AS trending FROM ts_stats",
          ["slope", "std"])
def trend_slope_test_q(spark, sf):
    return tr.trend_slope_test(fx.events_walk(spark, sf).select("series_id", "t", "y"))


def _invert_sql(seas: bool, diff: bool) -> str:
    ytr_s = "(y - y96)" if seas else "y"
    ytr_prev = "(y1 - y97)" if seas else "y1"
    ytr = f"({ytr_s} - {ytr_prev})" if diff else ytr_s
    prev = "CASE WHEN y96 IS NOT NULL THEN y - y96 ELSE y END" if seas else "y"
    parts = []
    for h in (1, 2, 3):
        cum = " + ".join(f"p{j}" for j in range(1, h + 1))
        level = f"({prev}) + ({cum})" if diff else f"p{h}"
        out = f"CASE WHEN b{h} IS NOT NULL THEN b{h} + ({level}) ELSE ({level}) END" if seas else f"({level})"
        parts.append(f"SELECT series_id, t, CAST({h} AS BIGINT) AS step, {out} AS y_pred_orig FROM ok")
    return q.with_(G, q.SEASONAL, f"""
base AS (SELECT series_id, t, y, lag(y, 96) OVER w AS y96, lag(y, 1) OVER w AS y1, lag(y, 97) OVER w AS y97,
                lag(y, 95) OVER w AS b1, lag(y, 94) OVER w AS b2, lag(y, 93) OVER w AS b3
         FROM events_seasonal WINDOW w AS (PARTITION BY series_id ORDER BY t)),
trn AS (SELECT *, {ytr} AS ytr FROM base),
prd AS (SELECT *, ytr AS p1, lag(ytr, 1) OVER w AS p2, lag(ytr, 2) OVER w AS p3
        FROM trn WINDOW w AS (PARTITION BY series_id ORDER BY t)),
ok AS (SELECT * FROM prd WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL)""") + " UNION ALL ".join(parts)


def _invert_q(seas: bool, diff: bool):
    def run(spark, sf):
        """Transformed-domain forecasts p_h = y_tr(t-h+1) mapped back to levels."""
        series = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
        ytr = tr.difference(series, seas, diff, out="y_tr")
        p = fe.windowed(ytr, lambda w: [F.array(*[F.lag("y_tr", h - 1).over(w) for h in (1, 2, 3)]).alias("_p")], 2, 0)
        p = p.where(F.forall("_p", lambda v: v.isNotNull()))
        pred = p.select("series_id", "t", F.posexplode("_p").alias("_i", "y_pred")).select(
            "series_id", "t", (F.col("_i") + 1).cast("long").alias("step"), "y_pred")
        out = tr.invert_forecasts(pred, series, seas, diff)
        return out.select("series_id", "t", "step", "y_pred_orig")
    return run


for _name, _s, _d in (("invert_none", False, False), ("invert_diff", False, True),
                      ("invert_seas", True, False), ("invert_seas_diff", True, True)):
    register(_name, _invert_sql(_s, _d), ["y_pred_orig"])(_invert_q(_s, _d))


@register("original_truth", q.with_(G, """
lt AS (SELECT series_id, t, lead(y, 1) OVER w AS l1, lead(y, 2) OVER w AS l2, lead(y, 3) OVER w AS l3
       FROM events_grid WINDOW w AS (PARTITION BY series_id ORDER BY t))""") + """
SELECT series_id, t, CAST(1 AS BIGINT) AS step, l1 AS y_true FROM lt WHERE l1 IS NOT NULL
UNION ALL SELECT series_id, t, CAST(2 AS BIGINT), l2 FROM lt WHERE l2 IS NOT NULL
UNION ALL SELECT series_id, t, CAST(3 AS BIGINT), l3 FROM lt WHERE l3 IS NOT NULL""", ["y_true"])
def original_truth_q(spark, sf):
    return tr.original_truth(fx.events_grid(spark, sf).select("series_id", "t", "y"))


# ---------------------------------------------------------------- splits
@register("temporal_split", q.with_(G, persist_cte("events_grid")) + "SELECT series_id, t, split FROM sp")
def temporal_split_q(spark, sf):
    tg = fe.multistep_targets(fx.events_grid(spark, sf).select("series_id", "t", "y"), 3)
    return sp.temporal_split(tg).select("series_id", "t", "split")


@register("holdout_split", q.with_(G, """
smp AS (SELECT series_id, t, lead(y, 3) OVER (PARTITION BY series_id ORDER BY t) AS l3 FROM events_grid),
ok AS (SELECT series_id, t FROM smp WHERE t >= 29 AND l3 IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i,
              count(*) OVER (PARTITION BY series_id) AS n FROM ok)""") +
          "SELECT series_id, t, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM ix")
def holdout_split_q(spark, sf):
    tg = fe.multistep_targets(fx.events_grid(spark, sf).select("series_id", "t", "y"), 3).where(F.col("t") >= 29)
    return sp.holdout_split(tg).select("series_id", "t", "split")


@register("gapped_cv_split", q.with_(G, """
ix AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i,
              count(*) OVER (PARTITION BY series_id) AS n FROM events_grid),
fl AS (SELECT ix.*, CAST(f AS BIGINT) AS fold, floor(n / 6) AS sz, n - (5 - f + 1) * floor(n / 6) AS st
       FROM ix, range(1, 6) AS r(f)),
rl AS (SELECT series_id, t, fold, CASE WHEN i < st - 8 THEN 'train' WHEN i >= st AND i < st + sz THEN 'test' END AS role
       FROM fl WHERE sz > 0)""") + "SELECT * FROM rl WHERE role IS NOT NULL")
def gapped_cv_split_q(spark, sf):
    return sp.gapped_cv_split(fx.events_grid(spark, sf).select("series_id", "t", "y"))


@register("minmax_scale", q.with_(G, """
ix AS (SELECT series_id, t, y, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i,
              count(*) OVER (PARTITION BY series_id) AS n FROM events_grid),
spl AS (SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM ix),
bnd AS (SELECT series_id, min(y) AS lo, max(y) AS hi FROM spl WHERE split = 'train' GROUP BY series_id)""") +
          "SELECT s.series_id, s.t, s.split, s.y, (s.y - b.lo) / CASE WHEN b.hi = b.lo THEN 1.0 ELSE b.hi - b.lo END AS y_sc "
          "FROM spl s JOIN bnd b USING (series_id)", ["y", "y_sc"])
def minmax_scale_q(spark, sf):
    g = sp.temporal_split(fx.events_grid(spark, sf).select("series_id", "t", "y"))
    return sp.minmax_scale(g, ["y"]).select("series_id", "t", "split", "y", "y_sc")


# ---------------------------------------------------------------- metrics
SP = q.with_(G, q.SEASONAL, persist_cte("events_seasonal"))


def _pf_seasonal(spark, sf):
    return persistence_forecasts(fx.events_seasonal(spark, sf))


def _metric_q(metric: str):
    def run(spark, sf):
        return me.forecast_metrics(_pf_seasonal(spark, sf), ["series_id", "split", "step"]).select(
            "series_id", "split", "step", metric)
    return run


for _m in q.METRIC_COLS:
    register(_m, f"SELECT series_id, split, step, {_m} FROM (" + SP + q.metrics_sql("pl", "series_id, split, step") + ")",
             [_m])(_metric_q(_m))


@register("weighted_f24", SP + """, mt AS (""" + q.metrics_sql("pl", "series_id, split, step") + """)
SELECT series_id, split, sum(CASE step WHEN 1 THEN 5.0 WHEN 2 THEN 3.0 WHEN 3 THEN 2.0 END * f24) / 10.0 AS weighted_f24
FROM mt GROUP BY series_id, split""", ["weighted_f24"])
def weighted_f24_q(spark, sf):
    m = me.forecast_metrics(_pf_seasonal(spark, sf), ["series_id", "split", "step"])
    return me.weighted_f24(m, ["series_id", "split"])


@register("weighted_rmse", SP + """, mt AS (""" + q.metrics_sql("pl", "series_id, split, step") + """)
SELECT series_id, split, sum(CASE step WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 END * rmse) AS weighted_rmse
FROM mt GROUP BY series_id, split""", ["weighted_rmse"])
def weighted_rmse_q(spark, sf):
    m = me.forecast_metrics(_pf_seasonal(spark, sf), ["series_id", "split", "step"])
    return me.weighted_rmse(m, ["series_id", "split"])


@register("mase", SP + """,
nv AS (SELECT series_id, avg(abs(d)) AS naive FROM (SELECT series_id, y - lag(y, 1) OVER (PARTITION BY series_id ORDER BY t) AS d
       FROM events_seasonal) WHERE d IS NOT NULL GROUP BY series_id),
fe AS (SELECT series_id, step, avg(abs(y_true - y_pred)) AS fe FROM pl WHERE split = 'test' GROUP BY series_id, step)
SELECT f.series_id, f.step, f.fe / CASE WHEN n.naive = 0 THEN 1e-10 ELSE n.naive END AS mase
FROM fe f JOIN nv n USING (series_id)""", ["mase"])
def mase_q(spark, sf):
    series = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    pf = persistence_forecasts(series).where(F.col("split") == "test")
    return me.mase(pf, series, by=["step"])


@register("performance_summary", q.with_(G, q.SEASONAL, """
dt AS (SELECT series_id, t, y, y - lag(y, 1) OVER w AS ytr, lead(y, 1) OVER w AS o1, lead(y, 2) OVER w AS o2,
              lead(y, 3) OVER w AS o3 FROM events_seasonal WINDOW w AS (PARTITION BY series_id ORDER BY t)),
dt2 AS (SELECT *, lead(ytr, 1) OVER w AS r1, lead(ytr, 2) OVER w AS r2, lead(ytr, 3) OVER w AS r3
        FROM dt WINDOW w AS (PARTITION BY series_id ORDER BY t)),
ok AS (SELECT * FROM dt2 WHERE ytr IS NOT NULL AND r3 IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i,
              count(*) OVER (PARTITION BY series_id) AS n FROM ok),
te AS (SELECT * FROM ix WHERE i >= floor(n * 0.8)),
pl AS (
  SELECT series_id, 'transformed' AS domain, CAST(1 AS BIGINT) AS step, r1 AS y_true, ytr AS y_pred FROM te
  UNION ALL SELECT series_id, 'transformed', 2, r2, ytr FROM te
  UNION ALL SELECT series_id, 'transformed', 3, r3, ytr FROM te
  UNION ALL SELECT series_id, 'original', 1, o1, y + ytr FROM te
  UNION ALL SELECT series_id, 'original', 2, o2, y + 2 * ytr FROM te
  UNION ALL SELECT series_id, 'original', 3, o3, y + 3 * ytr FROM te),
mt AS (""" + q.metrics_sql("pl", "series_id, domain, step") + """)""") +
          "SELECT mt.*, CASE step WHEN 1 THEN 5.0 WHEN 2 THEN 3.0 WHEN 3 THEN 2.0 END AS weight FROM mt",
          ["weight", *q.METRIC_COLS])
def performance_summary_q(spark, sf):
    """Persistence in the differenced domain of the seasonal series, scored in both domains
    (transformed truths, and levels recovered by the exact inversion)."""
    from tidemark.plans.forecast import long_targets
    series = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    d = tr.difference(series, False, True, out="y_tr")
    tg = fe.multistep_targets(d.where(F.col("y_tr").isNotNull()), 3, value="y_tr")
    tg = sp.temporal_split(tg).where(F.col("split") == "test")
    trans = long_targets(tg, 3, "y_tr", extra=["y_tr"]).withColumnRenamed("y_tr", "y_pred")
    pred = trans.select("series_id", "t", "step", "y_pred")
    levels = tr.invert_forecasts(pred, series, False, True)
    truth = tr.original_truth(series)
    orig = levels.join(truth, on=["series_id", "t", "step"]).select(
        "series_id", "step", "y_true", F.col("y_pred_orig").alias("y_pred"))
    both = trans.select("series_id", "step", "y_true", "y_pred").withColumn("domain", F.lit("transformed")).unionByName(
        orig.withColumn("domain", F.lit("original")))
    m = me.forecast_metrics(both, ["series_id", "domain", "step"])
    return me.performance_summary(m)


RUNS = """
runs AS (SELECT event_type AS series_id, CAST(user_id % 8 AS BIGINT) AS run, avg(value) AS score
         FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)"""


def _runs(spark, sf):
    ev = fx.table(spark, sf, "events").where("event_type IS NOT NULL")
    return ev.groupBy(F.col("event_type").alias("series_id"), F.pmod("user_id", F.lit(8)).cast("long").alias("run")) \
        .agg(F.avg("value").alias("score"))


@register("run_stats", q.with_(RUNS) + """
SELECT series_id, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max,
       quantile_cont(score, 0.5) AS median, CAST(count(*) AS BIGINT) AS n_runs FROM runs GROUP BY series_id""",
          ["mean", "std", "min", "max", "median"])
def run_stats_q(spark, sf):
    return me.run_stats(_runs(spark, sf), ["series_id"], "score")


@register("best_run", q.with_(RUNS) + """
SELECT series_id, arg_min(run, (score, run)) AS best_run, min(score) AS best_score FROM runs GROUP BY series_id""",
          ["best_score"])
def best_run_q(spark, sf):
    return me.best_run(_runs(spark, sf), ["series_id"], "score")


@register("convergence_curve", q.with_("""
daily AS (SELECT event_type AS series_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS iteration,
          avg(value) AS score FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)""") + """
SELECT series_id, iteration, min(score) OVER (PARTITION BY series_id ORDER BY iteration
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_score FROM daily""", ["best_score"])
def convergence_curve_q(spark, sf):
    ev = fx.table(spark, sf, "events").where("event_type IS NOT NULL AND ts IS NOT NULL")
    hist = ev.groupBy(F.col("event_type").alias("series_id"),
                      F.unix_date(F.col("ts").cast("date")).cast("long").alias("iteration")).agg(F.avg("value").alias("score"))
    return me.convergence_curve(hist, ["series_id"])


@register("forecast_errors", SP + """
SELECT series_id, t, step, y_true, y_pred, y_pred - y_true AS error, abs(y_pred - y_true) AS abs_error,
       100.0 * (y_pred - y_true) / (y_true + 1e-8) AS pct_error FROM pl WHERE split = 'test'""",
          ["y_true", "y_pred", "error", "abs_error", "pct_error"])
def forecast_errors_q(spark, sf):
    pf = _pf_seasonal(spark, sf).where(F.col("split") == "test")
    return me.forecast_errors(pf).drop("split")


@register("data_info", q.with_(G, persist_cte("events_grid")) +
          "SELECT series_id, split, CAST(count(*) AS BIGINT) AS n_rows FROM sp GROUP BY series_id, split")
def data_info_q(spark, sf):
    tg = fe.multistep_targets(fx.events_grid(spark, sf).select("series_id", "t", "y"), 3)
    return me.data_info(sp.temporal_split(tg), ["series_id"])


# ---------------------------------------------------------------- decomposition quality
from tidemark.operators import quality as qa  # noqa: E402

QUALITY = """
pt AS (SELECT series_id, t, sum(value) AS c_sum,
              sum(CASE WHEN component <> 'residual' THEN value * value ELSE 0 END) AS m_sq,
              sum(CASE WHEN component = 'residual' THEN value * value ELSE 0 END) AS r_sq
       FROM events_components GROUP BY series_id, t),
pairs AS (SELECT a.series_id, sum(a.value * b.value) AS cross_sum FROM events_components a
          JOIN events_components b ON a.series_id = b.series_id AND a.t = b.t AND a.k < b.k
          WHERE a.component <> 'residual' AND b.component <> 'residual' GROUP BY a.series_id),
kc AS (SELECT series_id, CAST(count(DISTINCT component) AS BIGINT) AS K FROM events_components
       WHERE component <> 'residual' GROUP BY series_id),
st AS (SELECT g.series_id, avg(pow(g.y - p.c_sum, 2)) AS mse, avg(g.y * g.y) AS power, var_pop(g.y) AS var_x,
              stddev_pop(g.y) AS std_x, sum(g.y * g.y) AS e_signal, sum(p.m_sq) AS e_modes, sum(p.r_sq) AS e_resid
       FROM events_grid g JOIN pt p ON g.series_id = p.series_id AND g.t = p.t GROUP BY g.series_id),
sx AS (SELECT st.*, kc.K, pairs.cross_sum,
              CASE WHEN e_modes > 0 THEN 2 * abs(cross_sum) / e_modes ELSE 0.0 END AS oi,
              CASE WHEN power > 0 THEN sqrt(mse / power) ELSE 0.0 END AS rrmse_power,
              sqrt(mse) / CASE WHEN std_x > 0 THEN std_x ELSE 1e-8 END AS rrmse_std,
              abs(K - 6) / 6.0 + 0.1 * greatest(K - 10, 0) AS cpx,
              CASE WHEN e_signal > 0 THEN abs(e_modes + e_resid - e_signal) / e_signal ELSE 0.0 END AS energy_gap
       FROM st JOIN kc USING (series_id) JOIN pairs USING (series_id)),
mlen AS (SELECT series_id, component, max(t) + 1 AS n FROM events_components WHERE component <> 'residual'
         GROUP BY series_id, component),
mw AS (SELECT c.series_id, c.component, c.value, m.n, least(50, m.n // 10) AS w, c.t
       FROM events_components c JOIN mlen m USING (series_id, component)),
wv AS (SELECT series_id, component, t // w AS j, var_pop(value) AS v FROM mw
       WHERE w > 0 AND (t // w) * w < n - w GROUP BY series_id, component, t // w),
vs AS (SELECT m.series_id, m.component,
              CASE WHEN count(wv.v) <= 1 THEN 0.0 WHEN avg(wv.v) > 0 THEN stddev_pop(wv.v) / avg(wv.v) ELSE 1.0 END AS variance_stability
       FROM mlen m LEFT JOIN wv USING (series_id, component) GROUP BY m.series_id, m.component),
lc AS (SELECT series_id, component, value, lag(value, 1) OVER (PARTITION BY series_id, component ORDER BY t) AS prev
       FROM events_components WHERE component <> 'residual'),
ac AS (SELECT series_id, component, CASE WHEN count(*) > 10 THEN coalesce(abs(corr(prev, value)), 0.0) ELSE 0.0 END AS lag1_autocorr
       FROM lc GROUP BY series_id, component),
mq AS (SELECT series_id, avg(variance_stability + 1 - lag1_autocorr) AS mode_quality FROM vs JOIN ac USING (series_id, component)
       GROUP BY series_id),
pq AS (SELECT sx.*, 0.4 * mse / CASE WHEN var_x > 0 THEN var_x ELSE 1e-8 END + 0.3 * coalesce(mode_quality, 0.0)
              + 0.2 * cpx + 0.1 * energy_gap AS predictive_quality FROM sx LEFT JOIN mq USING (series_id))"""
C = q.with_(G, q.COMPONENTS, QUALITY)
# components that do not add up to the series: without the residual
LOSSY = q.with_(G, q.COMPONENTS, "lossy AS (SELECT * FROM events_components WHERE component <> 'residual')",
                QUALITY.replace("events_components", "lossy"))


def _comp(spark, sf):
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return fx.rolling_bands(g), g


def _lossy(spark, sf):
    comps, g = _comp(spark, sf)
    return comps.where(F.col("component") != "residual"), g


@register("components_wide", q.with_(G, q.COMPONENTS, WIDE) + "SELECT series_id, t, IMF_1, IMF_2, residual FROM wide",
          ["IMF_1", "IMF_2", "residual"])
def components_wide_q(spark, sf):
    from tidemark.sources.series import components_to_wide
    return components_to_wide(fx.events_components(spark, sf), names=["IMF_1", "IMF_2", "residual"])


@register("row_sum_target", q.with_(G, q.COMPONENTS, WIDE) +
          "SELECT series_id, t, coalesce(IMF_1, 0) + coalesce(IMF_2, 0) + coalesce(residual, 0) AS sum FROM wide", ["sum"])
def row_sum_target_q(spark, sf):
    from tidemark.sources.series import components_to_wide, row_sum_target
    w = components_to_wide(fx.events_components(spark, sf))
    return row_sum_target(w, ["IMF_1", "IMF_2", "residual"], "sum").select("series_id", "t", "sum")


@register("reconstruction_error", LOSSY + "SELECT series_id, mse AS reconstruction_mse FROM sx", ["reconstruction_mse"])
def reconstruction_error_q(spark, sf):
    return qa.reconstruction_error(*_lossy(spark, sf))


@register("orthogonality_index", C + "SELECT series_id, oi AS orthogonality_index FROM sx", ["orthogonality_index"])
def orthogonality_index_q(spark, sf):
    return qa.orthogonality_index(*_comp(spark, sf))


@register("energy_distribution", C + """
, en AS (SELECT series_id, component, sum(value * value) AS energy FROM events_components GROUP BY series_id, component
         UNION ALL SELECT series_id, 'Total', sum(value * value) FROM events_components GROUP BY series_id)
SELECT en.series_id, en.component, en.energy, en.energy / st.e_signal * 100 AS energy_pct
FROM en JOIN st USING (series_id)""", ["energy", "energy_pct"])
def energy_distribution_q(spark, sf):
    return qa.energy_distribution(*_comp(spark, sf))


@register("rrmse_power", LOSSY + "SELECT series_id, rrmse_power FROM sx", ["rrmse_power"])
def rrmse_power_q(spark, sf):
    return qa.rrmse(*_lossy(spark, sf), by="power")


@register("rrmse_std", LOSSY + "SELECT series_id, rrmse_std FROM sx", ["rrmse_std"])
def rrmse_std_q(spark, sf):
    return qa.rrmse(*_lossy(spark, sf), by="std")


@register("variance_stability", C + "SELECT series_id, component, variance_stability FROM vs", ["variance_stability"])
def variance_stability_q(spark, sf):
    return qa.variance_stability(_comp(spark, sf)[0])


@register("lag1_autocorr", C + "SELECT series_id, component, lag1_autocorr FROM ac", ["lag1_autocorr"])
def lag1_autocorr_q(spark, sf):
    return qa.lag1_autocorr(_comp(spark, sf)[0])


@register("complexity_penalty", C + "SELECT series_id, K, CAST(cpx AS DOUBLE) AS complexity_penalty FROM sx",
          ["complexity_penalty"])
def complexity_penalty_q(spark, sf):
    return qa.complexity_penalty(_comp(spark, sf)[0])


@register("energy_gap", C + "SELECT series_id, energy_gap FROM sx", ["energy_gap"])
def energy_gap_q(spark, sf):
    return qa.energy_gap(*_comp(spark, sf))


@register("predictive_quality", C + "SELECT series_id, predictive_quality FROM pq", ["predictive_quality"])
def predictive_quality_q(spark, sf):
    return qa.predictive_quality(*_comp(spark, sf))


@register("predictive_quality_lossy", LOSSY + "SELECT series_id, predictive_quality FROM pq", ["predictive_quality"])
def predictive_quality_lossy_q(spark, sf):
    """Components that miss the residual: the error term counts."""
    return qa.predictive_quality(*_lossy(spark, sf))


@register("quality_report", C + """
, rep AS (SELECT series_id, [
    {'i': 1, 'm': 'Number of IMFs', 'v': CAST(K AS VARCHAR)},
    {'i': 2, 'm': 'Optimized Epsilon', 'v': printf('%.6f', 0.0)},
    {'i': 3, 'm': 'Optimization Strategy', 'v': 'predictive'},
    {'i': 4, 'm': 'Reconstruction Error (RRMSE)', 'v': printf('%.6e', CASE WHEN rrmse_std < 1e-12 THEN 0.0 ELSE rrmse_std END)},
    {'i': 5, 'm': 'Orthogonality Index (OI)', 'v': printf('%.6f', oi)},
    {'i': 6, 'm': 'Predictive Quality Score', 'v': printf('%.6f', predictive_quality)},
    {'i': 7, 'm': 'Signal Energy', 'v': printf('%.6e', e_signal)},
    {'i': 8, 'm': 'Total Decomposition Energy', 'v': printf('%.6e', e_modes + e_resid)},
    {'i': 9, 'm': 'Energy Preservation Ratio', 'v': printf('%.6f', (e_modes + e_resid) / e_signal)},
    {'i': 10, 'm': 'Noise Type', 'v': 'Laplace_White_Noise'},
    {'i': 11, 'm': 'Bayesian Optimization Status', 'v': 'Disabled'}] AS r FROM pq)
SELECT series_id, CAST(e.i AS BIGINT) AS metric_idx, e.m AS metric, e.v AS value
FROM (SELECT series_id, unnest(r) AS e FROM rep)""")
def quality_report_q(spark, sf):
    return qa.quality_report(*_comp(spark, sf))


@register("main_period", q.with_(G, q.SEASONAL, """
ms AS (SELECT series_id, count(*) AS n, avg(y) AS mu FROM events_seasonal GROUP BY series_id),
xs AS (SELECT s.series_id, s.t, s.y - m.mu AS x FROM events_seasonal s JOIN ms m USING (series_id)),
bins AS (SELECT series_id, n, unnest(range(1, n // 2)) AS k FROM ms),
pw AS (SELECT b.series_id, b.n, b.k,
              pow(sum(x.x * cos((2 * pi() / b.n) * ((x.t * b.k) % b.n))), 2)
              + pow(sum(x.x * sin((2 * pi() / b.n) * ((x.t * b.k) % b.n))), 2) AS p
       FROM bins b JOIN xs x USING (series_id) GROUP BY b.series_id, b.n, b.k),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p DESC, k) AS r FROM pw)""") + """
SELECT m.series_id, CASE WHEN m.n < 4 OR rk.k IS NULL THEN CAST(m.n AS DOUBLE) ELSE m.n / rk.k END AS main_period
FROM ms m LEFT JOIN rk ON rk.series_id = m.series_id AND rk.r = 1""", ["main_period"])
def main_period_q(spark, sf):
    return qa.main_period(fx.events_seasonal(spark, sf).select("series_id", "t", "y"))


@register("frequency_band_weight", q.with_("""
per AS (SELECT event_type AS series_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
               count(*) / 4.0 AS period FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)""") + """
SELECT series_id, day, period, CAST(h AS BIGINT) AS horizon,
       CASE WHEN period < 1.5 * h THEN 0.25 WHEN period <= 8 * h THEN 1.0 ELSE 0.5 END AS weight
FROM per, (VALUES (1), (4)) AS hs(h)""", ["period", "weight"])
def frequency_band_weight_q(spark, sf):
    ev = fx.table(spark, sf, "events").where("event_type IS NOT NULL AND ts IS NOT NULL")
    per = ev.groupBy(F.col("event_type").alias("series_id"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("day")) \
        .agg((F.count(F.lit(1)) / 4.0).alias("period"))
    return qa.frequency_band_weights(per)


@register("balanced_score", C + "SELECT series_id, 0.2 * oi + 0.5 * rrmse_power * 100 + 0.3 * abs(K - 6) / 6.0 AS balanced_score FROM sx",
          ["balanced_score"])
def balanced_score_q(spark, sf):
    return qa.balanced_score(*_comp(spark, sf))


@register("balanced_score_lossy", LOSSY + "SELECT series_id, 0.2 * oi + 0.5 * rrmse_power * 100 + 0.3 * abs(K - 6) / 6.0 AS balanced_score FROM sx",
          ["balanced_score"])
def balanced_score_lossy_q(spark, sf):
    """Components that miss the residual: the error term counts."""
    return qa.balanced_score(*_lossy(spark, sf))


# ---------------------------------------------------------------- search rules
from tidemark.operators import search as se  # noqa: E402

LAGF = q.with_(G, q.SEASONAL, "lg AS (SELECT series_id, y, " + ", ".join(
    f"lag(y, {k}) OVER (PARTITION BY series_id ORDER BY t) AS l{k}" for k in range(2, 9)) + """ FROM events_seasonal),
fl AS (SELECT series_id, """ + ", ".join(f"corr(y, l{k}) AS f{k}" for k in range(2, 9)) + """ FROM lg GROUP BY series_id),
sel AS (SELECT series_id, list_concat([1], list_filter([""" + ", ".join(
    f"CASE WHEN f{k} > 0.5 THEN {k} ELSE NULL END" for k in range(2, 9)) + """], lambda x: x IS NOT NULL)) AS lags FROM fl)""")


@register("lag_subset_rule", LAGF + """
SELECT series_id, array_to_string(lags[1:6], ',') AS lags, CAST(len(lags[1:6]) AS BIGINT) AS n_lags FROM sel""")
def lag_subset_rule_q(spark, sf):
    """Lag flags = autocorrelation at lags 2..8 of the seasonal series; the rule keeps lag 1
    plus flagged lags, at most six, smallest first."""
    s = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    lagged = fe.lags(s, 8)
    from tidemark.functions.columns import safe_corr
    flags = lagged.groupBy("series_id").agg(
        F.array(*[safe_corr(F.col("y"), F.col(f"y_lag_{k}")) for k in range(2, 9)]).alias("flags"))
    chosen = flags.select("series_id", se.lag_subset(F.col("flags")).alias("lags"))
    return chosen.select("series_id", F.array_join(F.col("lags").cast("array<string>"), ",").alias("lags"),
                         F.size("lags").cast("long").alias("n_lags"))


AG = rec(G, ALPHA_GRID_SQL, f"""
ag AS (SELECT g.series_id, a.alpha_idx, a.alpha, g.t, g.y FROM events_grid g JOIN agrid a USING (series_id)),
ags AS (SELECT series_id, alpha_idx, alpha, t, y, y AS s FROM ag WHERE t = 0
  UNION ALL SELECT g.series_id, g.alpha_idx, g.alpha, g.t, g.y, g.alpha * g.y + (1 - g.alpha) * r.s
  FROM ags r JOIN ag g ON g.series_id = r.series_id AND g.alpha_idx = r.alpha_idx AND g.t = r.t + 1),
agl AS (SELECT *, lag(s, 1) OVER (PARTITION BY series_id, alpha_idx ORDER BY t) AS s_prev FROM ags),
sse AS (SELECT series_id, alpha_idx, alpha, sum(pow(y - s_prev, 2)) AS sse FROM agl GROUP BY series_id, alpha_idx, alpha),
coarse AS (SELECT series_id, arg_min(alpha, (sse, alpha)) AS ref_alpha, min(sse) AS ref_sse FROM sse
           WHERE alpha_idx IN (0, 5, 10, 15, 19) GROUP BY series_id),
fine AS (SELECT series_id, arg_min(alpha, (sse, alpha)) AS fine_alpha, min(sse) AS fine_sse FROM sse GROUP BY series_id)""")


def _alpha_sse(spark, sf):
    return alpha_grid_smooth_q(spark, sf)


@register("refine_bounds", AG + """
SELECT series_id, ref_alpha, ref_sse, greatest(0.1, ref_alpha - 0.15) AS lower, least(0.8, ref_alpha + 0.15) AS upper
FROM coarse""", ["ref_alpha", "ref_sse", "lower", "upper"])
def refine_bounds_q(spark, sf):
    """Best of a coarse reference grid (every fifth alpha) and the refined search window around it."""
    sse = _alpha_sse(spark, sf)
    coarse = se.best_by(sse.where(F.col("alpha_idx").isin(0, 5, 10, 15, 19)), ["series_id"], "alpha", "sse", "ref")
    lo, hi = se.refine_bounds(F.col("ref_alpha"))
    return coarse.select("series_id", "ref_alpha", "ref_sse", lo.alias("lower"), hi.alias("upper"))


@register("improvement_gate", AG + """
SELECT series_id, ref_alpha, fine_alpha, (ref_sse - fine_sse) / ref_sse AS gain,
       CASE WHEN (ref_sse - fine_sse) / ref_sse > 0 THEN fine_alpha ELSE ref_alpha END AS chosen_p1,
       CASE WHEN (ref_sse - fine_sse) / ref_sse >= 0.05 THEN fine_alpha ELSE ref_alpha END AS chosen_p2
FROM coarse JOIN fine USING (series_id)""", ["ref_alpha", "fine_alpha", "gain", "chosen_p1", "chosen_p2"])
def improvement_gate_q(spark, sf):
    """Refined (all 20 alphas) vs reference (every fifth) best: keep the refined value only on enough gain."""
    sse = _alpha_sse(spark, sf)
    coarse = se.best_by(sse.where(F.col("alpha_idx").isin(0, 5, 10, 15, 19)), ["series_id"], "alpha", "sse", "ref")
    fine = se.best_by(sse, ["series_id"], "alpha", "sse", "fine")
    j = coarse.join(fine, on="series_id")
    r, f = F.col("ref_sse"), F.col("fine_sse")
    return j.select(
        "series_id", "ref_alpha", "fine_alpha", ((r - f) / r).alias("gain"),
        se.improvement_gate(F.col("ref_alpha"), r, F.col("fine_alpha"), f, se.P1_MIN_GAIN).alias("chosen_p1"),
        se.improvement_gate(F.col("ref_alpha"), r, F.col("fine_alpha"), f, se.P2_MIN_GAIN).alias("chosen_p2"))


# ---------------------------------------------------------------- backtests and unit-root tests (rows-only checks)
from tidemark.operators import backtest as bt  # noqa: E402


@register("rolling_ar_backtest")
def rolling_ar_backtest_q(spark, sf):
    """Expanding-window AR(8) MASE per series for horizons 1 and 4 on the seasonal series."""
    s = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    return bt.rolling_ar_backtest(s, horizons=(1, 4))


@register("rolling_ar_first_order", q.with_(G, q.SEASONAL, """
l1 AS (SELECT series_id, t, y, lag(y, 1) OVER (PARTITION BY series_id ORDER BY t) AS x,
              max(t) OVER (PARTITION BY series_id) + 1 AS n FROM events_seasonal),
fit AS (SELECT series_id, t, y, x, n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a
        FROM l1 WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fe AS (SELECT series_id, avg(abs(y - (a + b * x))) AS fe, count(*) AS n_forecasts FROM fit
       WHERE t >= 128 AND (t - 128) % 8 = 0 AND t < n - 1 GROUP BY series_id),
nv AS (SELECT series_id, avg(abs(y - x)) AS nv FROM l1 GROUP BY series_id)""") + """
SELECT series_id, CAST(1 AS BIGINT) AS horizon, fe / nv AS mase, CAST(n_forecasts AS BIGINT) AS n_forecasts
FROM fe JOIN nv USING (series_id)""", ["mase"])
def rolling_ar_first_order_q(spark, sf):
    """The backtest with one lag and one step: expanding simple regressions."""
    s = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    return bt.rolling_ar_backtest(s, p=1, horizon=1)


@register("adf_test")
def adf_test_q(spark, sf):
    """ADF statistics of the walk (integrated) and of the 15-minute grid (stationary)."""
    walk = fx.events_walk(spark, sf).select(F.concat(F.col("series_id"), F.lit("/walk")).alias("series_id"), "t", "y")
    grid = fx.events_grid(spark, sf).select(F.concat(F.col("series_id"), F.lit("/grid")).alias("series_id"), "t", "y")
    return bt.adf_test(walk.unionByName(grid))


@register("choose_transform")
def choose_transform_q(spark, sf):
    """Seasonal and difference flags per series, on the seasonal series and on the walk."""
    seas = fx.events_seasonal(spark, sf).select(F.concat(F.col("series_id"), F.lit("/seasonal")).alias("series_id"), "t", "y")
    walk = fx.events_walk(spark, sf).select(F.concat(F.col("series_id"), F.lit("/walk")).alias("series_id"), "t", "y")
    out = bt.choose_transform(seas.unionByName(walk))
    return out.select("series_id", "seas", "diff", "autocorr", "p_value", "used_lag",
                      F.to_json("ops").alias("ops"))


@register("pred_error_proxy")
def pred_error_proxy_q(spark, sf):
    """G16 over the three rolling bands of every event series."""
    comps, _ = _comp(spark, sf)
    return qa.pred_error_proxy(comps)


@register("forecastability_score")
def forecastability_score_q(spark, sf):
    comps, g = _comp(spark, sf)
    return qa.forecastability_score(comps, g)


@register("normalize_and_combine")
def normalize_and_combine_q(spark, sf):
    """The five forecastability parts of three band settings (short window 6, 12, 24),
    min-max normalised across the settings of each series and combined (G19)."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    parts = None
    for short in (6, 12, 24):
        p = qa.forecastability_components(fx.rolling_bands(g, short=short), g).withColumn("setting", F.lit(short).cast("long"))
        parts = p if parts is None else parts.unionByName(p)
    return qa.normalize_and_combine(parts)


# ---------------------------------------------------------------- ensemble decomposition (rows-only checks)
from tidemark.operators import decompose as dc  # noqa: E402

DECOMP_EPSILON = 0.2


@register("laplace_noise")
def laplace_noise_q(spark, sf):
    """Noise of every trial for every grid row, with its running moments per series and trial."""
    g = fx.events_grid(spark, sf).select("series_id", "t")
    rows = g.select("series_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dc.DEFAULT_TRIALS - 1).cast("long"))).alias("trial"))
    rows = rows.withColumn("w", dc.noise_column(F.lit(dc.DEFAULT_SEED), F.col("trial"), F.col("t")))
    return rows.groupBy("series_id", "trial").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"),
                                                 F.stddev_pop("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"))


@register("ensemble_decompose")
def ensemble_decompose_q(spark, sf):
    """100-trial noise-assisted decomposition of every 15-minute series."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return dc.ensemble_decompose(g, trials=dc.DEFAULT_TRIALS, epsilon=DECOMP_EPSILON)


@register("decomposition_residual")
def decomposition_residual_q(spark, sf):
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return dc.decomposition_residual(dc.ensemble_decompose(g, epsilon=DECOMP_EPSILON), g)


@register("trend_decompose")
def trend_decompose_q(spark, sf):
    """Zero-phase trend (alpha 0.3) plus decomposition of the smoothing residual."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return dc.trend_decompose(g, ALPHA, epsilon=DECOMP_EPSILON)


@register("batch_status")
def batch_status_q(spark, sf):
    """Per series status of the decomposition of the daily order series and of
    the 15-minute grid; series with fewer than 100 rows would be reported, not dropped."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    o = fx.orders_daily(spark, sf).select(F.concat(F.lit("orders/"), F.col("series_id")).alias("series_id"), "t", "y")
    allx = g.unionByName(o)
    return dc.batch_status(dc.ensemble_decompose(allx, epsilon=DECOMP_EPSILON, min_len=100), allx)


@register("batch_summary")
def batch_summary_q(spark, sf):
    """The scores of every decomposition of the 15-minute grid, one row per series."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return dc.batch_summary(cut_lineage(dc.ensemble_decompose(g, epsilon=DECOMP_EPSILON, min_len=100)), g)


@register("epsilon_grid_search")
def epsilon_grid_search_q(spark, sf):
    """Direct pipeline's epsilon search: reference grid, 25 refined points, 2 seeded runs,
    5 % gate, 100 trials, scored by the predictive quality."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return se.epsilon_search(g, qa.predictive_quality)


@register("alpha_search")
def alpha_search_q(spark, sf):
    """Trend pipeline's search: 20 smoothing factors in [0.01, 0.5] per series, each with its
    epsilon search (5 references, 25 refined points, 2 seeded runs, gate, 100 trials),
    scored by the forecastability score (the pipeline's ``predictive`` strategy)."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    return se.alpha_search(g, se.alpha_grid(ALPHA_LO, ALPHA_HI), qa.forecastability_score,
                           alpha_bounds=(ALPHA_LO, ALPHA_HI))


# ---------------------------------------------------------------- lag subset search (rows-only check)
def _seasonal_train_val(spark, sf):
    s = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    feats = fe.multistep_targets(fe.lags(s, 8), 3)
    feats = feats.na.drop()
    return sp.temporal_split(feats)


@register("lag_subset_search")
def lag_subset_search_q(spark, sf):
    """All 120 legal lag sets of an AR(8) ridge proxy scored by validation weighted F24."""
    sp_ = _seasonal_train_val(spark, sf)
    return se.lag_subset_search(sp_.where(F.col("split") == "train"), sp_.where(F.col("split") == "val"))


_VAL_F24 = ", ".join(f"(avg(pow(y{h} - (a{h} + b{h} * l1), 2)) + avg(abs(y{h} - (a{h} + b{h} * l1))) "
                     f"+ avg(abs(y{h} - (a{h} + b{h} * l1)) / (abs(y{h}) + 1e-10))) / 3 AS f{h}" for h in (1, 2, 3))


@register("lag_subset_first", q.with_(G, q.SEASONAL, """
lt AS (SELECT series_id, t, lag(y, 1) OVER w AS l1, lag(y, 8) OVER w AS l8, lead(y, 1) OVER w AS y1,
              lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3
       FROM events_seasonal WINDOW w AS (PARTITION BY series_id ORDER BY t)),
ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n
       FROM lt WHERE l8 IS NOT NULL AND y3 IS NOT NULL),
ft AS (SELECT series_id, """ + ", ".join(
    f"regr_slope(y{h}, l1) AS b{h}, regr_intercept(y{h}, l1) AS a{h}" for h in (1, 2, 3)) + """
       FROM ix WHERE i < floor(n * 0.6) GROUP BY series_id),
sc AS (SELECT series_id, """ + _VAL_F24 + """ FROM ix JOIN ft USING (series_id)
       WHERE i >= floor(n * 0.6) AND i < floor(n * 0.8) GROUP BY series_id)""") + """
SELECT series_id, CAST(0 AS BIGINT) AS cand_id, '1' AS lags, (5 * f1 + 3 * f2 + 2 * f3) / 10 AS weighted_f24, true AS best FROM sc""",
          ["weighted_f24"])
def lag_subset_first_q(spark, sf):
    """The search's score of lag set {1} without penalty: simple regressions per step."""
    rows = _seasonal_train_val(spark, sf)
    return se.lag_subset_search(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val"), max_lag=1,
                                ridge=0.0)


# ---------------------------------------------------------------- models (rows-only checks)
from tidemark.operators import models as mo  # noqa: E402
from tidemark.plans import pipelines as pl  # noqa: E402

MODEL_TREES = 500
MODEL_LR = 0.3
JOINT_LR = 0.03
BOOSTER_GRID = [(rate, trees) for rate in (0.01, 0.05, 0.1, 0.3, 1.0) for trees in (10, 100, 500, 2000)]


def _trend_forecast(spark, sf) -> dict:
    """The L3 flow with its searches; run once a session and input, shared by the queries below."""
    made = spark.__dict__.setdefault("_tidemark_forecasts", {})
    if sf not in made:
        made[sf] = pl.trend_forecast(fx.events_seasonal(spark, sf), candidates=BOOSTER_GRID)
    return made[sf]


@register("fit_boosted_multistep")
def fit_boosted_multistep_q(spark, sf):
    """Per-step boosters on the seasonal series (transform chosen per series); test-split forecasts."""
    out = _trend_forecast(spark, sf)
    test = out["table"].where(F.col("split") == "test")
    return mo.predict_multistep(out["models"], test, extra=["split"])


@register("evaluate_splits")
def evaluate_splits_q(spark, sf):
    """Metrics per split, domain and step of the trend-forecast flow."""
    return _trend_forecast(spark, sf)["summary"]


@register("feature_importance")
def feature_importance_q(spark, sf):
    """Every feature's importance per step and their mean (step NULL), ranked."""
    return mo.importance_frame(spark, _trend_forecast(spark, sf)["models"])


@register("feature_importance_top")
def feature_importance_top_q(spark, sf):
    """The report of the 20 most important features per step and of the mean."""
    return mo.importance_frame(spark, _trend_forecast(spark, sf)["models"], top=20)


@register("joint_boosted_multistep")
def joint_boosted_multistep_q(spark, sf):
    """One booster for all steps (vector leaves, 500 rounds at rate 0.03, stopped on the
    validation rows); metrics per split, domain and step."""
    flow = pl.trend_forecast(fx.events_seasonal(spark, sf), learning_rate=JOINT_LR, n_trees=MODEL_TREES, joint=True)
    return flow["summary"]


@register("booster_search")
def booster_search_q(spark, sf):
    """Five learning rates x four tree counts scored by validation weighted F24; running best."""
    table, features = pl.booster_features(fx.events_seasonal(spark, sf), seas=True, diff=False)
    table = cut_lineage(table)
    return mo.booster_search(table.where("split = 'train'"), table.where("split = 'val'"), features, BOOSTER_GRID,
                             target=pl.BOOSTER_TARGET)


@register("fit_sequence_regressor")
def fit_sequence_regressor_q(spark, sf):
    """Look-back-30 windows of the three bands -> per-step linear models -> metrics per series and step."""
    out = pl.sequence_forecast(fx.events_components(spark, sf))
    return out["metrics"].join(out["weighted_rmse"], on="series_id")


@register("stability_runs")
def stability_runs_q(spark, sf):
    """Three seeded refits of the step-1..3 boosters; weighted RMSE per run, with run statistics."""
    table, features = pl.booster_features(fx.events_seasonal(spark, sf), seas=True, diff=False)
    table = cut_lineage(table)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")

    def fit(df, seed):
        return mo.fit_boosted_multistep(df, features, 3, pl.BOOSTER_TARGET, MODEL_LR, MODEL_TREES, seed)["models"]

    def predict(models, df):
        p = mo.predict_multistep(models, df)
        truth = df.select("series_id", "t", F.posexplode(F.array(*[F.col(f"{pl.BOOSTER_TARGET}_step_{h}") for h in (1, 2, 3)]))
                          .alias("_i", "y_true")).select("series_id", "t", (F.col("_i") + 1).cast("long").alias("step"), "y_true")
        return p.join(truth, on=["series_id", "t", "step"])

    runs = mo.stability_runs(train, test, fit, predict, seeds=[42, 43, 44]).withColumn("_all", F.lit(1))
    stats = me.run_stats(runs, ["_all"], "weighted_rmse")
    best = me.best_run(runs, ["_all"], "weighted_rmse")
    return runs.join(stats, on="_all").join(best, on="_all").drop("_all")


# ---------------------------------------------------------------- result tables
@register("abs_error_nullsafe", q.with_(G, """
ah AS (SELECT series_id, t, y, lead(y, 1) OVER w AS l1, lead(y, 2) OVER w AS l2, lead(y, 3) OVER w AS l3
       FROM events_grid WINDOW w AS (PARTITION BY series_id ORDER BY t))""") + """
SELECT series_id, t, CAST(1 AS BIGINT) AS step, l1 AS y_true, y AS y_pred, abs(l1 - y) AS abs_error FROM ah
UNION ALL SELECT series_id, t, 2, l2, y, abs(l2 - y) FROM ah
UNION ALL SELECT series_id, t, 3, l3, y, abs(l3 - y) FROM ah""", ["y_true", "y_pred", "abs_error"])
def abs_error_nullsafe_q(spark, sf):
    """Persistence forecasts from every origin; the error is NULL where the truth lies past the end."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    wide = fe.windowed(g, lambda w: [F.array(*[F.lead("y", h).over(w) for h in (1, 2, 3)]).alias("_l")], 0, 3)
    long = wide.select("series_id", "t", "y", F.posexplode("_l").alias("_i", "y_true")).select(
        "series_id", "t", (F.col("_i") + 1).cast("long").alias("step"), "y_true", F.col("y").alias("y_pred"))
    return long.withColumn("abs_error", me.abs_error_nullsafe("y_true", "y_pred"))


@register("prediction_table", SP + """
SELECT pl.series_id, pl.t,
  max(CASE WHEN step = 1 THEN y_true END) AS true_step_1, max(CASE WHEN step = 1 THEN y_pred END) AS pred_step_1,
  max(CASE WHEN step = 2 THEN y_true END) AS true_step_2, max(CASE WHEN step = 2 THEN y_pred END) AS pred_step_2,
  max(CASE WHEN step = 3 THEN y_true END) AS true_step_3, max(CASE WHEN step = 3 THEN y_pred END) AS pred_step_3,
  max(f.y_lag_1) AS y_lag_1, max(f.y_lag_2) AS y_lag_2
FROM pl JOIN (SELECT series_id, t, lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2 FROM events_seasonal
              WINDOW w AS (PARTITION BY series_id ORDER BY t)) f ON f.series_id = pl.series_id AND f.t = pl.t
WHERE pl.split = 'test' GROUP BY pl.series_id, pl.t""",
          ["true_step_1", "pred_step_1", "true_step_2", "pred_step_2", "true_step_3", "pred_step_3", "y_lag_1", "y_lag_2"])
def prediction_table_q(spark, sf):
    """Wide per-row report of the test-split persistence forecasts with two lag features."""
    s = fx.events_seasonal(spark, sf).select("series_id", "t", "y")
    pf = persistence_forecasts(s).where(F.col("split") == "test")
    feats = fe.lags(s, 2)
    return me.prediction_table(pf, features=feats, feature_cols=["y_lag_1", "y_lag_2"], steps=(1, 2, 3))


# ---------------------------------------------------------------- G19 on the SQL-expressible parts
QUALITY_PART_WEIGHTS = {"rrmse": 0.15, "oi": 0.10, "cpx": 0.10, "energy_gap": 0.10}
BAND_SETTINGS = (6, 12, 24)


def _settings_sql() -> str:
    blocks = []
    for short in BAND_SETTINGS:
        blocks.append(f"""
b{short} AS (SELECT series_id, t, y,
   avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {short - 1} PRECEDING AND CURRENT ROW) AS ms,
   avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS ml FROM events_grid),
s{short} AS (SELECT series_id, CAST({short} AS BIGINT) AS setting,
   avg(pow(y - ((y - ms) + (ms - ml) + ml), 2)) AS mse, avg(y * y) AS power, sum(y * y) AS e_signal,
   sum((y - ms) * (y - ms) + (ms - ml) * (ms - ml)) AS e_modes, sum(ml * ml) AS e_resid,
   sum((y - ms) * (ms - ml)) AS cross_sum FROM b{short} GROUP BY series_id)""")
    union = " UNION ALL ".join(f"SELECT * FROM s{short}" for short in BAND_SETTINGS)
    return ",".join(blocks) + f""",
parts AS (SELECT series_id, setting,
   CASE WHEN power > 0 THEN sqrt(mse / power) ELSE 0.0 END AS rrmse,
   CASE WHEN e_modes > 0 THEN 2 * abs(cross_sum) / e_modes ELSE 0.0 END AS oi,
   abs(2 - 6) / 6.0 + 0.1 * greatest(2 - 10, 0) AS cpx,
   CASE WHEN e_signal > 0 THEN abs(e_modes + e_resid - e_signal) / e_signal ELSE 0.0 END AS energy_gap
   FROM ({union}))"""


def _norm_sql() -> str:
    terms = []
    for m, w in QUALITY_PART_WEIGHTS.items():
        lo = f"min({m}) OVER (PARTITION BY series_id)"
        hi = f"max({m}) OVER (PARTITION BY series_id)"
        terms.append(f"{w!r} * CASE WHEN {hi} - {lo} < 1e-10 THEN 0.0 ELSE ({m} - {lo}) / ({hi} - {lo} + 1e-10) END")
    return "SELECT series_id, setting, 0.0 + " + " + ".join(terms) + " AS combined_score FROM parts"


@register("normalize_and_combine_parts", q.with_(G, _settings_sql()) + _norm_sql(), ["combined_score"])
def normalize_and_combine_parts_q(spark, sf):
    """G19's min-max normalisation and weighting across three band settings, on
    the four parts SQL can state (rrmse, OI, complexity, energy gap)."""
    g = fx.events_grid(spark, sf).select("series_id", "t", "y")
    parts = None
    for short in BAND_SETTINGS:
        comps = fx.rolling_bands(g, short=short)
        st = qa.series_stats(comps, g).select(
            "series_id", F.lit(short).cast("long").alias("setting"), qa.rrmse_power_col().alias("rrmse"),
            qa.oi_col().alias("oi"), qa.cpx_col().cast("double").alias("cpx"), qa.energy_gap_col().alias("energy_gap"))
        parts = st if parts is None else parts.unionByName(st)
    return qa.normalize_and_combine(parts, weights=QUALITY_PART_WEIGHTS)


@register("data_info_summary", LAGF + "," + persist_cte("events_seasonal") + """
SELECT sp.series_id,
       CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS n_val,
       CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
       CAST(1 AS BIGINT) AS n_features, CAST(3 AS BIGINT) AS steps,
       any_value(array_to_string(sel.lags[1:6], ',')) AS lags
FROM sp JOIN sel ON sel.series_id = sp.series_id GROUP BY sp.series_id""")
def data_info_summary_q(spark, sf):
    """Rows per split of the persistence set-up (one feature: the current value,
    three steps) with the lags the rule selects for each series."""
    tg = fe.multistep_targets(fx.events_seasonal(spark, sf).select("series_id", "t", "y"), 3)
    lags = lag_subset_rule_q(spark, sf).select("series_id", "lags")
    return me.data_info_summary(sp.temporal_split(tg), ["series_id"], n_features=1, steps=3, lags=lags)
