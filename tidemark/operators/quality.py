"""Decomposition-quality statistics over long component tables.

``components(series_id, t, component, k, value)``: modes are the components
named ``IMF_*`` (any name but the residual), the residual is named
``residual``.  ``signal(series_id, t, y)`` is the decomposed series.  Every
statistic is a grouped aggregation; per-t sums over components come first
(one shuffle on (series_id, t)), then per-series totals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import band_weight, safe_corr
from tidemark.operators.features import windowed
from tidemark.operators.indexing import chunk_of, key_schema, series_length
from tidemark.session import chunk_rows

RESIDUAL = "residual"
# fixed values of the scores
K_TARGET = 6
K_SOFT_MAX = 10
VS_WINDOW_MAX = 50
FORECASTABILITY_WEIGHTS = {"pred_err_proxy": 0.55, "rrmse": 0.15, "oi": 0.10, "cpx": 0.10, "energy_gap": 0.10}


def is_mode(component: str = "component") -> Column:
    return F.col(component) != F.lit(RESIDUAL)


def _per_t(components: DataFrame, signal: DataFrame, keys=("series_id",), t: str = "t") -> DataFrame:
    """Per (series, t): signal, sum of all components, of modes, sum of squares of modes."""
    keys = list(keys)
    v = F.col("value")
    mode = is_mode()
    per_t = components.groupBy(*keys, t).agg(
        F.sum(v).alias("c_sum"),
        F.sum(F.when(mode, v).otherwise(0.0)).alias("m_sum"),
        F.sum(F.when(mode, v * v).otherwise(0.0)).alias("m_sq"),
        F.sum(F.when(~mode, v * v).otherwise(0.0)).alias("r_sq"),
    )
    return per_t.join(signal.select(*keys, t, F.col("y").alias("x")), on=[*keys, t], how="inner")


def series_stats(components: DataFrame, signal: DataFrame, keys=("series_id",), t: str = "t") -> DataFrame:
    """One row per series with every sum the statistics need."""
    keys = list(keys)
    if "sums" in components.columns:  # of ``measure_whole``
        return components.select(*keys, "sums.*")
    pt = _per_t(components, signal, keys, t)
    err = F.col("x") - F.col("c_sum")
    stats = pt.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.col("x") * F.col("x")).alias("power"),
        F.var_pop("x").alias("var_x"),
        F.stddev_pop("x").alias("std_x"),
        F.sum(F.col("x") * F.col("x")).alias("e_signal"),
        F.sum("m_sq").alias("e_modes"),
        F.sum("r_sq").alias("e_resid"),
        F.sum((F.col("m_sum") * F.col("m_sum") - F.col("m_sq")) / 2).alias("cross"),
    )
    kcount = components.where(is_mode()).groupBy(*keys).agg(F.countDistinct("component").cast("long").alias("K"))
    return stats.join(kcount, on=keys, how="left").fillna(0, subset=["K"])


def reconstruction_error(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """MSE(signal, sum of modes + residual)."""
    return series_stats(components, signal, keys).select(*keys, F.col("mse").alias("reconstruction_mse"))


def oi_col() -> Column:
    return F.when(F.col("e_modes") > 0, 2 * F.abs(F.col("cross")) / F.col("e_modes")).otherwise(F.lit(0.0))


def orthogonality_index(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """2 |sum_{i<j} sum_t c_i c_j| / sum c^2 over modes; 0 without energy.

    The pair sum is computed per t as ((sum c)^2 - sum c^2) / 2: one pass, no
    self-join of components."""
    return series_stats(components, signal, keys).select(*keys, oi_col().alias("orthogonality_index"))


def rrmse_power_col() -> Column:
    return F.when(F.col("power") > 0, F.sqrt(F.col("mse") / F.col("power"))).otherwise(F.lit(0.0))


def rrmse_std_col() -> Column:
    std = F.when(F.col("std_x") > 0, F.col("std_x")).otherwise(F.lit(1e-8))
    return F.sqrt(F.col("mse")) / std


def rrmse(components: DataFrame, signal: DataFrame, by: str = "power", keys=("series_id",)) -> DataFrame:
    """sqrt(MSE / mean(x^2)) (``power``) or sqrt(MSE) / std_pop(x) (``std``)."""
    col = rrmse_power_col() if by == "power" else rrmse_std_col()
    return series_stats(components, signal, keys).select(*keys, col.alias(f"rrmse_{by}"))


def cpx_col() -> Column:
    k = F.col("K")
    return F.abs(k - K_TARGET) / K_TARGET + F.lit(0.1) * F.greatest(k - K_SOFT_MAX, F.lit(0))


def complexity_penalty(components: DataFrame, keys=("series_id",)) -> DataFrame:
    """|K - 6| / 6 + 0.1 max(0, K - 10) over the number of modes K."""
    keys = list(keys)
    k = components.where(is_mode()).groupBy(*keys).agg(F.countDistinct("component").cast("long").alias("K"))
    return k.select(*keys, "K", cpx_col().cast("double").alias("complexity_penalty"))


def energy_gap_col() -> Column:
    return F.when(F.col("e_signal") > 0,
                  F.abs(F.col("e_modes") + F.col("e_resid") - F.col("e_signal")) / F.col("e_signal")).otherwise(F.lit(0.0))


def energy_gap(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """|E_modes + E_residual - E_signal| / E_signal."""
    return series_stats(components, signal, keys).select(*keys, energy_gap_col().alias("energy_gap"))


def energy_distribution(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """Energy per component and a ``Total`` row, with percent of signal energy."""
    keys = list(keys)
    e = components.groupBy(*keys, "component").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    total = e.groupBy(*keys).agg(F.sum("energy").alias("energy")).withColumn("component", F.lit("Total"))
    es = signal.groupBy(*keys).agg(F.sum(F.col("y") * F.col("y")).alias("_es"))
    rows = e.unionByName(total).join(es, on=keys, how="inner")
    return rows.select(*keys, "component", "energy", (F.col("energy") / F.col("_es") * 100).alias("energy_pct"))


def variance_stability(components: DataFrame, keys=("series_id",), t: str = "t") -> DataFrame:
    """Per mode: std_pop / mean of the population variances of windows of
    w = min(50, n // 10) rows starting at 0, w, 2w, ... < n - w; 0 with <= 1
    window; 1 when the mean is <= 0 (G8).  Two-level aggregation."""
    keys = list(keys)
    modes = components.where(is_mode())
    n = series_length(modes, [*keys, "component"], t, "_n")
    staged = modes.join(n, on=[*keys, "component"], how="inner").withColumn(
        "_w", F.least(F.lit(VS_WINDOW_MAX), F.floor(F.col("_n") / 10)).cast("long"))
    staged = staged.where(F.col("_w") > 0).withColumn("_j", F.floor(F.col(t) / F.col("_w")).cast("long"))
    staged = staged.where(F.col("_j") * F.col("_w") < F.col("_n") - F.col("_w"))
    wv = staged.groupBy(*keys, "component", "_j").agg(F.var_pop("value").alias("_v"))
    agg = wv.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_m"), F.stddev_pop("_v").alias("_s"),
                                             F.avg("_v").alias("_a"))
    vs = F.when(F.col("_m") <= 1, F.lit(0.0)).when(F.col("_a") > 0, F.col("_s") / F.col("_a")).otherwise(F.lit(1.0))
    out = n.select(*keys, "component").join(agg, on=[*keys, "component"], how="left")
    return out.select(*keys, "component", F.coalesce(vs, F.lit(0.0)).alias("variance_stability"))


def lag1_autocorr(components: DataFrame, keys=("series_id",), t: str = "t") -> DataFrame:
    """Per mode: |corr(c_t, c_{t+1})|; 0 when undefined or n <= 10."""
    keys = list(keys)
    modes = components.where(is_mode()).select(*keys, "component", t, "value")
    lagged = windowed(modes, lambda w: [F.lag("value", 1).over(w).alias("_prev")], 1, 0, [*keys, "component"], t)
    agg = lagged.groupBy(*keys, "component").agg(safe_corr(F.col("_prev"), F.col("value")).alias("_r"),
                                                 F.count(F.lit(1)).alias("_n"))
    ac = F.when(F.col("_n") > 10, F.coalesce(F.abs("_r"), F.lit(0.0))).otherwise(F.lit(0.0))
    return agg.select(*keys, "component", ac.alias("lag1_autocorr"))


def predictive_quality(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """0.4 MSE/var + 0.3 mean_k(VS_k + 1 - AC_k) + 0.2 cpx + 0.1 energy gap."""
    keys = list(keys)
    st = series_stats(components, signal, keys)
    per_mode = variance_stability(components, keys).join(lag1_autocorr(components, keys), on=[*keys, "component"])
    useful = per_mode.groupBy(*keys).agg(
        F.avg(F.col("variance_stability") + 1 - F.col("lag1_autocorr")).alias("mode_quality"))
    var = F.when(F.col("var_x") > 0, F.col("var_x")).otherwise(F.lit(1e-8))
    j = st.join(useful, on=keys, how="left")
    score = (F.lit(0.4) * F.col("mse") / var + F.lit(0.3) * F.coalesce(F.col("mode_quality"), F.lit(0.0))
             + F.lit(0.2) * cpx_col() + F.lit(0.1) * energy_gap_col())
    return j.select(*keys, score.alias("predictive_quality"))


QUALITY_METRICS = (
    "Number of IMFs", "Optimized Epsilon", "Optimization Strategy", "Reconstruction Error (RRMSE)",
    "Orthogonality Index (OI)", "Predictive Quality Score", "Signal Energy", "Total Decomposition Energy",
    "Energy Preservation Ratio", "Noise Type", "Bayesian Optimization Status",
)


def quality_report(components: DataFrame, signal: DataFrame, epsilon: DataFrame | float = 0.0,
                   strategy: str = "predictive", optimized: bool = False, keys=("series_id",)) -> DataFrame:
    """The 11 Metric/Value rows of a decomposition, values formatted as text.

    ``epsilon``: one number for all series, or a (keys, epsilon) table."""
    keys = list(keys)
    st = series_stats(components, signal, keys)
    pq = predictive_quality(components, signal, keys)
    j = st.join(pq, on=keys)
    if isinstance(epsilon, DataFrame):
        j = j.join(epsilon.select(*keys, F.col("epsilon").alias("_eps")), on=keys, how="left")
        eps = F.col("_eps")
    else:
        eps = F.lit(float(epsilon))
    total = F.col("e_modes") + F.col("e_resid")
    values = [
        F.col("K").cast("string"),
        F.format_string("%.6f", eps),
        F.lit(strategy),
        # reconstruction exact to float noise is reported as 0
        F.format_string("%.6e", F.when(rrmse_std_col() < F.lit(1e-12), F.lit(0.0)).otherwise(rrmse_std_col())),
        F.format_string("%.6f", oi_col()),
        F.format_string("%.6f", F.col("predictive_quality")),
        F.format_string("%.6e", F.col("e_signal")),
        F.format_string("%.6e", total),
        F.format_string("%.6f", total / F.col("e_signal")),
        F.lit("Laplace_White_Noise"),
        F.lit("Enabled" if optimized else "Disabled"),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("metric_idx"), F.lit(m).alias("metric"), v.alias("value"))
                     for i, (m, v) in enumerate(zip(QUALITY_METRICS, values))])
    return j.select(*keys, F.inline(rows))


# ---------------------------------------------------------------- main period
def _dft_partials(n_col: str):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf[n_col].iloc[0])
        k = np.arange(1, max(n // 2, 1))
        if len(k) == 0:
            return pd.DataFrame({"k": pd.Series([], dtype="int64"), "re": pd.Series([], dtype="float64"),
                                 "im": pd.Series([], dtype="float64")})
        t = pdf["t"].to_numpy(dtype=np.int64)
        x = pdf["_x"].to_numpy(dtype=np.float64)
        # phase (k t mod n) in exact integers keeps the angle accurate for long series
        ang = (2 * np.pi / n) * np.mod(np.outer(t, k), n)
        re = x @ np.cos(ang)
        im = -(x @ np.sin(ang))
        return pd.DataFrame({"k": k, "re": re, "im": im})
    return fn


FFT_GROUP_MAX = 1 << 16


def fft_split(n: int) -> int:
    """Divisor n1 of n closest to sqrt(n) from below (n = n1 * n2, n1 <= n2)."""
    if n <= 0:
        return 1
    for d in range(math.isqrt(n), 0, -1):
        if n % d == 0:
            return d
    return 1


FFT_BATCH_ROWS = 1 << 16


def _periodogram_four_step(x: DataFrame, keys, t: str) -> DataFrame:
    """Exact |DFT|^2 at bins 1..n//2-1 by a two-pass (four-step) FFT.

    x: (keys, t, _x, _n, _n1, _n2).  Pass 1 FFTs, for every j2 = t mod n2,
    the n1 values x[j1*n2 + j2] over j1 and applies the twiddle
    exp(-2 pi i j2 k1 / n); pass 2 FFTs, for every k1, the n2 pass-1 values
    over j2, giving X[k1 + n1*k2].  Each Arrow task takes a block of columns
    (at most ~65k rows) and transforms them with one 2-D FFT; the shuffle
    between the passes is the transpose."""
    ks = key_schema(x, keys)
    cap = F.lit(FFT_BATCH_ROWS)
    staged = x.withColumn("_j2", F.pmod(F.col(t), F.col("_n2"))).withColumn(
        "_j1", F.floor(F.col(t) / F.col("_n2")).cast("long"))
    staged = staged.withColumn("_g", F.floor(F.col("_j2") / F.greatest(F.lit(1), F.floor(cap / F.col("_n1")))).cast("long"))

    def pass1(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2 = int(pdf["_n"].iloc[0]), int(pdf["_n1"].iloc[0]), int(pdf["_n2"].iloc[0])
        pdf = pdf.sort_values(["_j2", "_j1"])
        j2 = pdf["_j2"].to_numpy()[::n1]
        mat = pdf["_x"].to_numpy(dtype=np.float64).reshape(len(j2), n1)
        y = np.fft.fft(mat, axis=1)
        k1 = np.arange(n1)
        y = y * np.exp(-2j * np.pi * (np.outer(j2, k1) % n) / n)
        out = pd.DataFrame({"_k1": np.tile(k1, len(j2)).astype("int64"), "_j2": np.repeat(j2, n1).astype("int64"),
                            "re": y.real.reshape(-1), "im": y.imag.reshape(-1), "_n": n, "_n1": n1, "_n2": n2})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    s1 = ", ".join(ks + ["_k1 long", "_j2 long", "re double", "im double", "_n long", "_n1 long", "_n2 long"])
    mid = staged.select(*keys, "_x", "_n", "_n1", "_n2", "_j1", "_j2", "_g").groupBy(*keys, "_g").applyInPandas(pass1, s1)
    mid = mid.withColumn("_g", F.floor(F.col("_k1") / F.greatest(F.lit(1), F.floor(cap / F.col("_n2")))).cast("long"))

    def pass2(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2 = int(pdf["_n"].iloc[0]), int(pdf["_n1"].iloc[0]), int(pdf["_n2"].iloc[0])
        pdf = pdf.sort_values(["_k1", "_j2"])
        k1 = pdf["_k1"].to_numpy()[::n2]
        mat = (pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()).reshape(len(k1), n2)
        z = np.fft.fft(mat, axis=1)
        k = (k1[:, None] + n1 * np.arange(n2)[None, :]).reshape(-1)
        p = (np.abs(z) ** 2).reshape(-1)
        keep = (k >= 1) & (k <= n // 2 - 1)
        out = pd.DataFrame({"k": k[keep].astype("int64"), "_p": p[keep]})
        for kk in reversed(keys):
            out.insert(0, kk, pdf[kk].iloc[0])
        return out

    s2 = ", ".join(ks + ["k long", "_p double"])
    return mid.groupBy(*keys, "_g").applyInPandas(pass2, s2)


def _periodogram_partial_dft(x: DataFrame, keys, t: str, size: int) -> DataFrame:
    """Exact |DFT|^2 from partial sums of bounded chunks (for lengths without a
    usable factorisation); O(n^2/2) work, spread over (series, chunk) tasks."""
    staged = x.select(*keys, t, "_x", "_n", chunk_of(t, size).alias("_c"))
    schema = ", ".join(key_schema(x, keys) + ["_c long", "k long", "re double", "im double"])

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        part = _dft_partials("_n")(pdf)
        for kcol in reversed(keys):
            part.insert(0, kcol, pdf[kcol].iloc[0])
        part["_c"] = int(pdf["_c"].iloc[0])
        return part[[*keys, "_c", "k", "re", "im"]]

    partial = staged.groupBy(*keys, "_c").applyInPandas(per_group, schema)
    return partial.groupBy(*keys, "k").agg((F.pow(F.sum("re"), 2) + F.pow(F.sum("im"), 2)).alias("_p"))


def main_period(signal: DataFrame, value: str = "y", keys=("series_id",), t: str = "t") -> DataFrame:
    """Dominant period n / k of the mean-removed periodogram over bins 1..n//2-1;
    first maximum wins; n < 4 or no bins gives n (G14).

    Distributed: a four-step FFT with groups of ~sqrt(n) rows when n factors
    into n1*n2 with n2 <= 65536, else partial DFT sums over bounded chunks.
    ``max_by`` picks the bin.
    """
    keys = list(keys)
    size = min(chunk_rows(signal.sparkSession), 4096)
    stats = signal.groupBy(*keys).agg((F.max(t) + 1).cast("long").alias("_n"), F.avg(value).alias("_mean"))

    @F.pandas_udf("long")
    def split_of(n: pd.Series) -> pd.Series:
        return n.map(lambda v: fft_split(int(v))).astype("int64")

    stats = stats.withColumn("_n1", split_of(F.col("_n"))).withColumn("_n2", (F.col("_n") / F.col("_n1")).cast("long"))
    x = signal.select(*keys, t, value).join(stats, on=keys).select(
        *keys, t, (F.col(value) - F.col("_mean")).alias("_x"), "_n", "_n1", "_n2")
    fast = F.col("_n2") <= F.lit(FFT_GROUP_MAX)
    power = _periodogram_four_step(x.where(fast), keys, t).unionByName(
        _periodogram_partial_dft(x.where(~fast), keys, t, size))
    rank = F.struct(F.col("_p").alias("p"), (-F.col("k")).alias("nk"))
    best = power.groupBy(*keys).agg(F.max_by(rank, rank).alias("_b"))
    out = stats.join(best, on=keys, how="left")
    period = F.when((F.col("_n") < 4) | F.col("_b").isNull(), F.col("_n").cast("double")).otherwise(
        F.col("_n") / (-F.col("_b.nk")))
    return out.select(*keys, period.cast("double").alias("main_period"))


def frequency_band_weights(periods: DataFrame, horizons=(1, 4), period: str = "period") -> DataFrame:
    """Band weight per period and horizon: 0.25 below 1.5H, 1 up to 8H, else 0.5."""
    hs = F.array(*[F.lit(h).cast("long") for h in horizons])
    return periods.select("*", F.explode(hs).alias("horizon")).withColumn("weight", band_weight(F.col(period), F.col("horizon")))


def balanced_score(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """0.2 OI + 50 rrmse(power) + 0.3 |K - 6| / 6 (G18, strategy ``balanced``)."""
    keys = list(keys)
    st = series_stats(components, signal, keys)
    score = F.lit(0.2) * oi_col() + F.lit(0.5) * rrmse_power_col() * 100 + F.lit(0.3) * F.abs(F.col("K") - K_TARGET) / K_TARGET
    return st.select(*keys, score.alias("balanced_score"))


def normalize_and_combine(scores: DataFrame, keys=("series_id",), setting: str = "setting",
                          weights=FORECASTABILITY_WEIGHTS) -> DataFrame:
    """Min-max each metric across the settings of a series (0 when the range is
    < 1e-10, denominator + 1e-10) and combine with fixed weights (G19)."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    total = F.lit(0.0)
    for m, wt in weights.items():
        lo, hi = F.min(m).over(w), F.max(m).over(w)
        norm = F.when(hi - lo < F.lit(1e-10), F.lit(0.0)).otherwise((F.col(m) - lo) / (hi - lo + F.lit(1e-10)))
        total = total + F.lit(wt) * norm
    return scores.select(*keys, setting, total.alias("combined_score"))


# ---------------------------------------------------------------- forecastability (needs the backtest)
PROXY_HORIZONS = (1, 4)


def _periods_and_errors(long: DataFrame, ck, horizons, t: str) -> DataFrame:
    """(ck, horizon, mase, main_period) of every component.

    Where every component has finite values at t = 0, 1, ... and at most a chunk
    of rows, a component is one Arrow group and both come from one pass over it;
    else they are spread over chunks."""
    from tidemark.operators.backtest import backtest_errors, rolling_ar_backtest

    n, top, places = F.count(F.lit(1)), F.max(t), F.sum(F.col(t).cast("double"))
    each = long.groupBy(*ck).agg(
        n.alias("n"), ((F.min(t) == 0) & (top == n - 1) & (2 * places == n * (n - 1)) & (F.count("y") == n)
                       & (F.sum(F.col("y") * 0.0) == 0.0)).alias("plain"))
    most, plain = each.agg(F.max("n"), F.min(F.coalesce("plain", F.lit(False)).cast("int"))).first()
    if not plain or most > chunk_rows(long.sparkSession):
        mase = rolling_ar_backtest(long, ck, "y", t, horizons=horizons).select(*ck, "horizon", "mase")
        return mase.join(main_period(long, "y", ck, t), on=ck)
    hs = sorted(set(horizons))

    def score(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, y = table.column(t).to_numpy(), table.column("y").to_numpy()
        if (at[1:] <= at[:-1]).any():
            order = np.argsort(at, kind="stable")
            at, y = at[order], y[order]
        if (at != np.arange(len(at))).any():
            raise ValueError(f"{t} of {[k.as_py() for k in key]} repeats")
        errors = backtest_errors(y, hs)
        return pa.table([*[pa.repeat(k, len(hs)) for k in key], pa.array(hs, pa.int64()), pa.array(errors, pa.float64()),
                         pa.array(np.full(len(hs), period_of(y)))], names=[*ck, "horizon", "mase", "main_period"])

    schema = ", ".join(key_schema(long, ck) + ["horizon long", "mase double", "main_period double"])
    return long.groupBy(*ck).applyInArrow(score, schema)


def measure_whole(rows: DataFrame, keys=("series_id",), horizons=PROXY_HORIZONS) -> DataFrame:
    """(keys, sums, measures) of the rows of ``whole_decompositions``, which the forecastability score takes in
    place of long components: ``series_stats`` of a decomposition, and energy, main period and backtest errors of
    each of its components.  Nothing is shuffled: a row has a whole decomposition."""
    from tidemark.operators.backtest import backtest_errors
    from tidemark.operators.decompose import component_name

    keys, hs = list(keys), sorted(set(horizons))
    schema = ", ".join([
        *key_schema(rows, keys),
        "sums struct<n: long, mse: double, power: double, var_x: double, std_x: double, e_signal: double, "
        "e_modes: double, e_resid: double, cross: double, K: long>",
        "measures array<struct<component: string, _ce: double, main_period: double, "
        "errors: array<struct<horizon: long, mase: double>>>>"])
    whole, real = pa.int64(), pa.float64()
    sums_type = pa.struct([("n", whole), *[(c, real) for c in ("mse", "power", "var_x", "std_x", "e_signal", "e_modes",
                                                              "e_resid", "cross")], ("K", whole)])
    errors_type = pa.list_(pa.struct([("horizon", whole), ("mase", real)]))
    measures_type = pa.list_(pa.struct([("component", pa.string()), ("_ce", real), ("main_period", real),
                                        ("errors", errors_type)]))

    def sums_of(x: np.ndarray, parts: np.ndarray) -> dict:
        modes, residue, err = parts[:-1], parts[-1], x - parts.sum(0)
        m_sum, m_sq = modes.sum(0), (modes * modes).sum(0)
        found = {"mse": (err * err).mean(), "power": (x * x).mean(), "var_x": x.var(), "std_x": x.std(),
                 "e_signal": (x * x).sum(), "e_modes": m_sq.sum(), "e_resid": (residue * residue).sum(),
                 "cross": ((m_sum * m_sum - m_sq) / 2).sum()}
        return {"n": len(x), **{k: float(v) for k, v in found.items()}, "K": len(modes)}

    def measures_of(parts: np.ndarray) -> list[dict]:
        return [{"component": component_name(k, len(parts)), "_ce": float((v * v).sum()), "main_period": period_of(v),
                 "errors": [{"horizon": h, "mase": e} for h, e in zip(hs, backtest_errors(v, hs))]}
                for k, v in enumerate(parts)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("y")[i].values.to_numpy()
                parts = np.stack([np.frombuffer(p.as_buffer(), float) for p in batch.column("parts")[i].values])
                parts = parts * batch.column("scale")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(i, 1) for k in keys], pa.array([sums_of(x, parts)], sums_type),
                     pa.array([measures_of(parts)], measures_type)],
                    names=[*keys, "sums", "measures"])

    return rows.mapInArrow(run, schema)


def period_of(y: np.ndarray) -> float:
    """``main_period`` of one whole series."""
    n = len(y)
    if n < 4:
        return float(n)
    power = np.abs(np.fft.rfft(y - y.mean())[1:n // 2]) ** 2
    return n / (int(power.argmax()) + 1)


def pred_error_proxy(components: DataFrame, keys=("series_id",), horizons=PROXY_HORIZONS, t: str = "t") -> DataFrame:
    """Energy-share x band-weight weighted MASE of AR backtests over all
    components (modes and residual), averaged over horizons; 1.0 without
    energy (G16).  Weights are normalised per horizon, equal when all zero."""
    keys = list(keys)
    ck = [*keys, "component"]
    if "measures" in components.columns:  # of ``measure_whole``
        each = components.select(*keys, F.aggregate("measures", F.lit(0.0), lambda s, m: s + m["_ce"]).alias("_tot"),
                                 F.inline("measures"))
        j = each.select("*", F.inline("errors")).where(F.col("horizon").isin(*horizons))
    else:
        long = components.select(*ck, t, F.col("value").alias("y"))
        energy = long.groupBy(*ck).agg(F.sum(F.col("y") * F.col("y")).alias("_ce"))
        tot = energy.groupBy(*keys).agg(F.sum("_ce").alias("_tot"), F.count(F.lit(1)).alias("_nc"))
        j = _periods_and_errors(long, ck, horizons, t).join(energy, on=ck).join(tot, on=keys)
    share = F.when(F.col("_tot") > 0, F.col("_ce") / F.col("_tot")).otherwise(F.lit(0.0))
    j = j.withColumn("_w", share * band_weight(F.col("main_period"), F.col("horizon")))
    per_h = j.groupBy(*keys, "horizon").agg(
        F.sum("_w").alias("_W"), F.sum(F.col("_w") * F.col("mase")).alias("_wm"), F.avg("mase").alias("_em"),
        F.first("_tot").alias("_tot"))
    eh = F.when(F.col("_W") > 0, F.col("_wm") / F.col("_W")).otherwise(F.col("_em"))
    out = per_h.groupBy(*keys).agg(F.avg(eh).alias("_p"), F.first("_tot").alias("_tot"))
    return out.select(*keys, F.when(F.col("_tot") > 0, F.col("_p")).otherwise(F.lit(1.0)).alias("pred_err_proxy"))


def forecastability_components(components: DataFrame, signal: DataFrame, keys=("series_id",)) -> DataFrame:
    """The five parts of the forecastability score per series."""
    keys = list(keys)
    st = series_stats(components, signal, keys).select(
        *keys, rrmse_power_col().alias("rrmse"), oi_col().alias("oi"), cpx_col().cast("double").alias("cpx"),
        energy_gap_col().alias("energy_gap"))
    return pred_error_proxy(components, keys).join(st, on=keys)


def forecastability_score(components: DataFrame, signal: DataFrame, keys=("series_id",),
                          weights=FORECASTABILITY_WEIGHTS) -> DataFrame:
    """0.55 proxy + 0.15 rrmse(power) + 0.10 OI + 0.10 cpx + 0.10 energy gap."""
    parts = forecastability_components(components, signal, keys)
    score = F.lit(0.0)
    for m, w in weights.items():
        score = score + F.lit(w) * F.col(m)
    return parts.withColumn("forecastability_score", score)


forecastability_score.measure = measure_whole  # it takes these measures too


def score_by_strategy(components: DataFrame, signal: DataFrame, strategy: str = "predictive",
                      keys=("series_id",)) -> DataFrame:
    """Decomposition score by strategy name (G18): ``predictive`` and
    ``comprehensive`` use the forecastability score, ``balanced`` the balanced
    score, any other name the orthogonality index alone.  Score column last."""
    keys = list(keys)
    if strategy in ("predictive", "comprehensive"):
        return forecastability_score(components, signal, keys).select(*keys, F.col("forecastability_score").alias("score"))
    if strategy == "balanced":
        return balanced_score(components, signal, keys).select(*keys, F.col("balanced_score").alias("score"))
    return orthogonality_index(components, signal, keys).select(*keys, F.col("orthogonality_index").alias("score"))
