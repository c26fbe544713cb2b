"""Expanding-window AR backtests and unit-root tests from aggregated sums
(G15, E4, E5/E6).

Rolling AR(p) backtest: the reference refits an OLS model at every origin.
Here each target row contributes z z^T (z = 1, p lags, target) to the bucket
of the first origin that sees it; a running sum over buckets gives the Gram of
every expanding window at once; one batched solve per origin follows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import windowed
from tidemark.operators.indexing import series_length, key_schema
from tidemark.operators.linalg import gram_columns, running_sums, solve_batched, unpack_gram
from tidemark.operators.scan import max_group_length
from tidemark.operators.transform import trend_slope_test

# fixed values of the backtest
AR_ORDER = 8
MIN_TRAIN = 128
ORIGIN_STEP = 8


def _center(df: DataFrame, keys, value: str) -> DataFrame:
    mu = df.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    return df.join(mu, on=keys).withColumn("_x", F.col(value) - F.col("_mu"))


def rolling_ar_forecasts(df: DataFrame, keys=("series_id",), value: str = "y", t: str = "t", p: int = AR_ORDER,
                         horizons=(1,), min_train: int = MIN_TRAIN, step: int = ORIGIN_STEP) -> DataFrame:
    """Recursive H-step AR(p)+intercept forecasts from every origin min_train,
    +step, ... with origin + H < n, for every H in ``horizons`` at once (the
    expanding-window Grams do not depend on H).  Returns (keys, horizon,
    origin, h, actual, forecast)."""
    keys = list(keys)
    horizons = sorted(set(int(h) for h in horizons))
    hmax = max(horizons)
    x = _center(df.select(*keys, t, value), keys, value)
    lag_cols = [f"_l{k}" for k in range(1, p + 1)]

    def make(w):
        cols = [F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, p + 1)]
        cols += [F.lead("_x", h).over(w).alias(f"_a{h}") for h in range(1, hmax)]
        return cols
    rows = windowed(x, make, p, max(hmax - 1, 0), keys, t)
    rows = rows.withColumn("_one", F.lit(1.0))
    design = ["_one", *lag_cols, "_x"]
    m = len(design)
    # bucket j collects targets t with origin min_train + step*j the first to train on them
    bucket = F.greatest(F.lit(0), F.ceil((F.col(t) - F.lit(min_train - 1)) / F.lit(step))).cast("long")
    targets = rows.where(F.col(t) >= p).withColumn("_j", bucket)
    grams = targets.groupBy(*keys, "_j").agg(*gram_columns(design))
    gcols = [c for c in grams.columns if c.startswith("g_")]
    cum = running_sums(grams, keys, "_j", gcols)
    n = series_length(df, keys, t, "_n")
    hmin = min(horizons)
    origins = rows.join(n, on=keys).where(
        (F.col(t) >= min_train) & (F.pmod(F.col(t) - min_train, F.lit(step)) == 0) & (F.col(t) < F.col("_n") - hmin)
        & (F.col("_n") >= min_train + p + hmin))
    origins = origins.withColumn("_j", ((F.col(t) - min_train) / step).cast("long"))
    actual = F.array(F.col("_x"), *[F.col(f"_a{h}") for h in range(1, hmax)])
    joined = origins.select(*keys, F.col(t).alias("origin"), "_n", "_j", "_mu",
                            F.array(*[F.col(c) for c in lag_cols]).alias("_lags"),
                            actual.alias("_act")).join(cum, on=[*keys, "_j"], how="inner")
    out_schema = ", ".join(key_schema(df, keys) + ["horizon long", "origin long", "h long", "actual double",
                                                   "forecast double"])

    def forecast(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            g = unpack_gram(pdf[gcols].to_numpy(dtype=np.float64), m)
            coef = solve_batched(g[:, :-1, :-1], g[:, :-1, -1])
            hist = np.stack(pdf["_lags"].to_numpy())  # x_{s-1}, ..., x_{s-p}
            preds = []
            for _ in range(hmax):
                nxt = coef[:, 0] + np.einsum("ki,ki->k", coef[:, 1:], hist)
                preds.append(nxt)
                hist = np.concatenate([nxt[:, None], hist[:, :-1]], axis=1)
            mu = pdf["_mu"].to_numpy()[:, None]
            pred = np.stack(preds, axis=1) + mu
            act = np.stack([np.asarray(a, dtype=float) for a in pdf["_act"].to_numpy()]) + mu
            origin, nrow = pdf["origin"].to_numpy(), pdf["_n"].to_numpy()
            for hz in horizons:
                ok = (origin < nrow - hz) & (nrow >= min_train + p + hz)
                k = int(ok.sum())
                if k == 0:
                    continue
                out = pd.DataFrame({"horizon": hz, "origin": np.repeat(origin[ok], hz),
                                    "h": np.tile(np.arange(1, hz + 1), k),
                                    "actual": act[ok, :hz].reshape(-1), "forecast": pred[ok, :hz].reshape(-1)})
                for key in reversed(keys):
                    out.insert(0, key, np.repeat(pdf[key].to_numpy()[ok], hz))
                yield out

    return joined.mapInPandas(forecast, out_schema)


def rolling_ar_backtest(df: DataFrame, keys=("series_id",), value: str = "y", t: str = "t", p: int = AR_ORDER,
                        horizon: int = 1, min_train: int = MIN_TRAIN, step: int = ORIGIN_STEP,
                        horizons=None) -> DataFrame:
    """MASE of all backtest forecasts against the naive error of the whole series;
    1.0 when the series is too short or yields no forecast (G15).  One row per
    (keys, horizon) for every horizon in ``horizons`` (default: ``horizon``)."""
    keys = list(keys)
    hs = sorted(set(horizons or [horizon]))
    fc = rolling_ar_forecasts(df, keys, value, t, p, hs, min_train, step)
    err = fc.groupBy(*keys, "horizon").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("_fe"),
                                           F.count(F.lit(1)).alias("n_forecasts"))
    d = windowed(df.select(*keys, t, value), lambda w: [(F.col(value) - F.lag(value, 1).over(w)).alias("_d")], 1, 0, keys, t)
    naive = d.groupBy(*keys).agg(F.avg(F.abs("_d")).alias("_nv"), F.count(F.lit(1)).alias("_n"))
    grid = naive.select("*", F.explode(F.array(*[F.lit(h).cast("long") for h in hs])).alias("horizon"))
    j = grid.join(err, on=[*keys, "horizon"], how="left")
    nv = F.when(F.col("_nv") == 0, F.lit(1e-10)).otherwise(F.col("_nv"))
    short = F.col("_n") < F.lit(min_train + p) + F.col("horizon")
    mase = F.when(F.col("_fe").isNull() | short, F.lit(1.0)).otherwise(F.col("_fe") / nv)
    return j.select(*keys, "horizon", mase.alias("mase"),
                    F.coalesce(F.col("n_forecasts"), F.lit(0)).cast("long").alias("n_forecasts"))


def backtest_errors(y: np.ndarray, horizons, p: int = AR_ORDER, min_train: int = MIN_TRAIN,
                    step: int = ORIGIN_STEP) -> list[float]:
    """``rolling_ar_backtest``'s MASE of one whole series for every horizon, from the same running Grams."""
    n, hmin, hmax = len(y), min(horizons), max(horizons)
    if n < min_train + p + hmin:
        return [1.0] * len(horizons)
    mu = y.mean()
    x = y - mu
    seen = np.lib.stride_tricks.sliding_window_view(x, p + 1)  # x_{s-p}, ..., x_s for s = p, p + 1, ...
    z = np.concatenate([np.ones((n - p, 1)), seen[:, -2::-1], seen[:, -1:]], axis=1)
    origins = np.arange(min_train, n - hmin, step)
    first = np.concatenate([[0], origins[:-1] - p])  # the rows each origin is the first to train on
    rows, cols = np.triu_indices(p + 2)
    packed = np.add.reduceat((z[:, rows] * z[:, cols])[:origins[-1] - p], first, axis=0).cumsum(axis=0)
    g = unpack_gram(packed, p + 2)
    coef = solve_batched(g[:, :-1, :-1], g[:, :-1, -1])
    hist, preds = z[origins - p, 1:-1], []
    for _ in range(hmax):
        preds.append(coef[:, 0] + np.einsum("ki,ki->k", coef[:, 1:], hist))
        hist = np.concatenate([preds[-1][:, None], hist[:, :-1]], axis=1)
    forecast = np.stack(preds, axis=1) + mu
    naive = np.abs(np.diff(y)).mean()
    out = []
    for h in horizons:
        ok = origins < n - h
        if n < min_train + p + h or not ok.any():
            out.append(1.0)
            continue
        actual = x[origins[ok][:, None] + np.arange(h)] + mu
        out.append(float(np.abs(actual - forecast[ok, :h]).mean() / (naive if naive != 0 else 1e-10)))
    return out


# ---------------------------------------------------------------- ADF
# fixed values: MacKinnon (1994) approximate p-value, constant-only regression
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALLP = (2.1659, 1.4412, 0.038269)
TAU_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = TAU_SMALLP if tau <= TAU_STAR else TAU_LARGEP
    z = sum(c * tau ** i for i, c in enumerate(coef))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def adf_max_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, int(math.ceil(12.0 * (n / 100.0) ** 0.25))))


def adf_max_lag_col(n):
    """Column form of adf_max_lag (Schwert's rule capped at n // 2 - 2)."""
    schwert = F.ceil(F.lit(12.0) * F.pow(n / F.lit(100.0), F.lit(0.25)))
    return F.greatest(F.lit(0), F.least(F.floor(n / 2) - 2, schwert)).cast("long")


def adf_test(df: DataFrame, keys=("series_id",), value: str = "y", t: str = "t", p_threshold: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC.

    Rows z_t = (1, x_{t-1}, dx_{t-1..t-L}, dx_t).  One Gram over the common
    sample (t > L) gives the AIC of every lag order by sub-matrices; the chosen
    order is refit on its own sample by adding the few head rows.  Returns
    (keys, n, used_lag, adf_stat, p_value, need_diff); need_diff falls back to
    the slope test when the statistic cannot be formed.
    """
    keys = list(keys)
    max_n = max_group_length(df, keys, t)
    big_l = adf_max_lag(max_n)
    x = _center(df.select(*keys, t, value), keys, value)

    def make(w):
        dx = F.col("_x") - F.lag("_x", 1).over(w)
        cols = [F.lag("_x", 1).over(w).alias("_lvl"), dx.alias("_dx")]
        cols += [(F.lag("_x", k).over(w) - F.lag("_x", k + 1).over(w)).alias(f"_d{k}") for k in range(1, big_l + 1)]
        return cols
    rows = windowed(x, make, big_l + 1, 0, keys, t)
    n = series_length(df, keys, t, "_n")
    rows = rows.join(n, on=keys).withColumn("_L", adf_max_lag_col(F.col("_n")))
    design = ["_one", "_lvl", *[f"_d{k}" for k in range(1, big_l + 1)], "_dx"]
    rows = rows.withColumn("_one", F.lit(1.0)).fillna(0.0, subset=[f"_d{k}" for k in range(1, big_l + 1)])
    m = len(design)
    common = rows.where((F.col(t) > F.col("_L")) & F.col("_dx").isNotNull())
    from tidemark.operators.linalg import partial_gram
    g = partial_gram(common, keys, design, t=t)
    packed = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("_g"))
    head = rows.where((F.col(t) >= 1) & (F.col(t) <= F.col("_L"))).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(t).alias("t"), F.array(*[F.col(c) for c in design]).alias("z"))).alias("_head"))
    per = n.join(packed, on=keys, how="left").join(head, on=keys, how="left")
    slope = trend_slope_test(df, value, keys, t).select(*keys, "trending")
    per = per.join(slope, on=keys, how="left")
    schema = ", ".join(key_schema(df, keys) + ["n long", "used_lag long", "adf_stat double", "p_value double",
                                                       "need_diff boolean"])

    def run(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                nn = int(r["_n"])
                lmax = adf_max_lag(nn)
                res = None
                if r["_g"] is not None and lmax >= 0 and nn - 1 - lmax > lmax + 3:
                    gm = np.zeros((m, m))
                    for e in r["_g"]:
                        gm[e["i"], e["j"]] = gm[e["j"], e["i"]] = e["v"]
                    hd = r["_head"]
                    res = _adf_from_gram(gm, [] if hd is None else list(hd), nn, lmax, m)
                if res is None:
                    out.append((*[r[k] for k in keys], nn, None, None, None, bool(r["trending"])))
                else:
                    lag, tau = res
                    pv = mackinnon_p(tau)
                    out.append((*[r[k] for k in keys], nn, lag, tau, pv, pv > p_threshold))
            yield pd.DataFrame(out, columns=[*keys, "n", "used_lag", "adf_stat", "p_value", "need_diff"])

    return per.mapInPandas(run, schema)


def _ols(g: np.ndarray, cols: list[int], target: int):
    a = g[np.ix_(cols, cols)]
    b = g[cols, target]
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    ssr = g[target, target] - 2 * beta @ b + beta @ a @ beta
    return beta, max(ssr, 0.0), a


def _adf_from_gram(g_common, head, n, lmax, m):
    target = m - 1
    nobs = n - 1 - lmax
    best = None
    for k in range(0, lmax + 1):
        cols = [0, 1, *range(2, 2 + k)]
        _, ssr, _ = _ols(g_common, cols, target)
        if ssr <= 0:
            continue
        aic = nobs * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1) + 2 * len(cols)
        if best is None or aic < best[0]:
            best = (aic, k)
    if best is None:
        return None
    k = best[1]
    g = g_common.copy()
    for h in head:
        if h["t"] >= k + 1:
            z = np.asarray(h["z"], dtype=float)
            g += np.outer(z, z)
    cols = [0, 1, *range(2, 2 + k)]
    beta, ssr, a = _ols(g, cols, target)
    dof = (n - 1 - k) - len(cols)
    if dof <= 0 or ssr <= 0:
        return None
    cov = np.linalg.pinv(a) * (ssr / dof)
    se = math.sqrt(cov[1, 1]) if cov[1, 1] > 0 else float("nan")
    if not se or math.isnan(se):
        return None
    return k, float(beta[1] / se)


def choose_transform(df: DataFrame, keys=("series_id",), value: str = "y", t: str = "t", season: int = 96) -> DataFrame:
    """Per series: seasonal flag from the lag-season autocorrelation and
    difference flag from the ADF test, both on the untransformed series (E6)."""
    from tidemark.operators.transform import seasonal_flags

    keys = list(keys)
    seas = seasonal_flags(df, season, value, keys, t).select(*keys, "seas", "autocorr")
    adf = adf_test(df, keys, value, t).select(*keys, F.col("need_diff").alias("diff"), "p_value", "used_lag")
    out = seas.join(adf, on=keys, how="inner")
    ops = F.filter(F.array(
        F.when(F.col("seas"), F.struct(F.lit("seas").alias("op"), F.lit(season).alias("period"))),
        F.when(F.col("diff"), F.struct(F.lit("diff").alias("op"), F.lit(1).alias("period")))), lambda o: o.isNotNull())
    return out.withColumn("ops", ops)
