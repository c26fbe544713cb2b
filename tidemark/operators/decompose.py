"""Ensemble decomposition as Spark jobs.

Candidates (epsilon, seed run, alpha ...) are rows, dealt out by (series,
candidate).  Where all trials of a pair (hash-seeded Laplace noise, G1) hold a
bounded number of points, a task finds all modes of its pairs, with the noise
made once per seed and length.  Longer series go stage by stage, all pairs
together: a stage's tasks are pairs times blocks of trials, whose noise modes
are a table, and their sums are added up by a shuffle into the next mode.  So
memory does not grow with the number of trials; a series is one row.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import laplace_noise, laplace_noise_np
from tidemark.operators.emd import emd_all, first_modes, keep_heap, n_extrema
from tidemark.operators.indexing import key_schema, series_length
from tidemark.session import chunk_rows, cut_lineage

BLOCK_POINTS = 1 << 19  # trials times points of one task
TRIAL_BLOCKS = 8  # blocks that trials are dealt into at least
TASK_WAVES = 8  # tasks of whole decompositions for each core: they differ in length
BROADCAST_BYTES = 1 << 26  # noise terms of one number that are sent to every executor
MOST_STAGES = 500  # beyond this something is wrong: an error, not a result
# fixed values of the decomposition
DEFAULT_TRIALS = 100
DEFAULT_EPSILON = 0.02
DEFAULT_SEED = 42
RUN_SEED_STRIDE = 1000


def task_partitions(spark) -> int:
    """Partitions for CPU-heavy grouped tasks: at least every core of the cluster."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def noise_column(seed: Column, trial: Column, t: Column) -> Column:
    """Laplace white noise, std 1, a pure function of (seed, trial, t) (G1)."""
    return laplace_noise(seed, trial, t)


def ensemble_decompose(series: DataFrame, candidates: DataFrame | None = None, trials: int = DEFAULT_TRIALS,
                       epsilon: float = DEFAULT_EPSILON, seed: int = DEFAULT_SEED, max_modes: int | None = None,
                       keys=("series_id",), value: str = "y", t: str = "t", min_len: int = 4) -> DataFrame:
    """Complete-ensemble decomposition of every (series, candidate).

    ``candidates``: optional (keys..., cand_id, epsilon, seed) rows, e.g. an
    epsilon grid x seed runs per series; default one candidate per series.
    Works on x / std(x).  Stage k takes the mean over the trials of the first
    mode of r_k + epsilon std(r_k) E_k(w_i) as the next mode; it ends for a
    candidate when its residue has fewer than 3 extrema (or at ``max_modes``).
    Output: (keys, cand_id, epsilon, seed, t, component, k, value, status,
    error_message) where components are IMF_1..IMF_K and ``residual``
    (signal minus the modes).  Failed tasks emit one row with NULL component.
    """
    keys = list(keys)
    good, failed, ident = _candidate_rows(series, candidates, epsilon, seed, keys, value, t, min_len)
    cols = [*key_schema(good, keys), "cand_id long, epsilon double, seed long, t long, component string, k long, "
                                     "value double, status string, error_message string"]
    out_schema = ", ".join(cols)
    fits = F.size("y").cast("long") * F.lit(trials) <= F.lit(BLOCK_POINTS)

    def lay_out(parts):
        """A row per point of every (name, number, bytes) that ``parts`` finds in a row, scaled back."""
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):  # one row per series and candidate
                    for name, number, points in parts(batch, i):
                        v = np.frombuffer(points, float) * batch.column("scale")[i].as_py()
                        same = [pa.repeat(batch.column(c)[i], len(v)) for c in ident]
                        name_, number_, done = (pa.repeat(pa.scalar(x), len(v)) for x in (name, number, "Success"))
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(np.arange(len(v))), name_, number_, pa.array(v), done, pa.nulls(len(v), pa.string())],
                            names=[*ident, "t", "component", "k", "value", "status", "error_message"])
        return run

    def all_parts(batch, i):
        parts = batch.column("parts")[i].as_py()
        return [(component_name(k, len(parts)), k + 1, p) for k, p in enumerate(parts)]

    def one_part(what, name, number):
        return lambda batch, i: [(name, number, batch.column(what)[i].as_py())]

    whole = cut_lineage(_whole_decompositions(good.where(fits), ident, trials, max_modes))
    states = _staged_decompositions(good.where(~fits), ident, trials, max_modes)
    found = [failed, whole.mapInArrow(lay_out(all_parts), out_schema)]
    for k, state in enumerate(states):
        if k:
            found.append(state.mapInArrow(lay_out(one_part("mode", f"IMF_{k}", k)), out_schema))
        found.append(state.where(~F.col("going")).mapInArrow(lay_out(one_part("r", "residual", k + 1)), out_schema))
    return reduce(DataFrame.unionByName, found)


def _candidate_rows(series: DataFrame, candidates: DataFrame | None, epsilon: float, seed: int, keys: list[str], value: str,
                    t: str, min_len: int):
    """Candidates with their series as an array (keys, cand_id, epsilon, seed, y); rows of the output for those
    whose series cannot be decomposed; the columns that name a candidate."""
    base = series.select(*keys, F.col(t).cast("long").alias("_t"), F.col(value).cast("double").alias("_y"))
    whole = base.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", "_y"))).alias("_s"))
    n = F.size("_s")
    steady = (F.col("_s")[0]["_t"] == 0) & (F.col("_s")[n - 1]["_t"] == n - 1) & F.forall("_s", lambda p: p["_y"].isNotNull())
    why = F.when(n < min_len, F.format_string(f"series has %d rows, fewer than {min_len}", n)).when(
        ~steady, F.lit("series index is not contiguous from 0, or a value is NULL"))
    whole = cut_lineage(whole.select(*keys, why.alias("_why"), F.transform("_s", lambda p: p["_y"]).alias("y")))
    if candidates is None:
        cands = whole.select(*keys, F.lit(0).cast("long").alias("cand_id"), F.lit(float(epsilon)).alias("epsilon"),
                             F.lit(int(seed)).cast("long").alias("seed"))
    else:
        cands = candidates.select(*keys, F.col("cand_id").cast("long"), F.col("epsilon").cast("double"),
                                  F.col("seed").cast("long"))
    rows = whole.join(cands, on=keys)
    ident = [*keys, "cand_id", "epsilon", "seed"]
    failed = rows.where(F.col("_why").isNotNull()).select(
        *ident, F.lit(None).cast("long").alias("t"),
        F.lit(None).cast("string").alias("component"), F.lit(None).cast("long").alias("k"),
        F.lit(None).cast("double").alias("value"), F.lit("Error").alias("status"), F.col("_why").alias("error_message"))
    return rows.where(F.col("_why").isNull()).select(*ident, "y"), failed, ident


def component_name(k: int, parts: int) -> str:
    """Name of part ``k`` of a decomposition into ``parts``, the last of which is the residue."""
    return f"IMF_{k + 1}" if k < parts - 1 else "residual"


def _scaled(y) -> tuple[np.ndarray, float, bool]:
    """The series over its deviation, that deviation (1 if there is none), whether it has modes."""
    x = np.array(y, dtype=float)
    scale = float(np.std(x))
    x = x / scale if scale > 0 else x
    return x, scale if scale > 0 else 1.0, bool(scale > 0 and len(x) >= 4 and n_extrema(x) >= 3)


def _next_mode(r: np.ndarray, alone: np.ndarray, sums: list[np.ndarray], noisy: int, trials: int):
    """Mode, residue after it and whether that may have more modes, from the sums over ``noisy`` trials with a noise
    term of this number; the others add the plain residue's first mode each."""
    total = alone * (trials - noisy)
    for part in sums:
        total = total + part
    mode = total / trials
    rest = r - mode
    return mode, rest, bool(n_extrema(rest) >= 3 and np.abs(mode).max() > 0)


def _noise_block(seed: int, n: int, first: int, count: int) -> list[np.ndarray]:
    """The noise terms of a block of trials, [count, n] each.  Term 0 is the noise over its deviation, the others its
    modes over the first one's."""
    trial = np.arange(first, first + count, dtype=np.int64)[:, None]
    w = laplace_noise_np(seed, trial, np.arange(n, dtype=np.int64)[None, :])
    deviation = np.std(w, axis=1, keepdims=True)
    terms = [w / np.where(deviation > 0, deviation, 1)]
    modes = emd_all(w)
    if modes:
        size = np.std(modes[0], axis=1, keepdims=True)
        terms += [m / np.where(size > 0, size, 1) for m in modes[1:]]
    return terms


@lru_cache(maxsize=2)
def _noise_blocks(seed: int, n: int, trials: int) -> list[list[np.ndarray]]:
    """The noise terms of all trials, for at most BLOCK_POINTS points; kept for the next candidates of this worker."""
    size = -(-trials // TRIAL_BLOCKS)
    return [_noise_block(seed, n, first, min(size, trials - first)) for first in range(0, trials, size)]


def _whole_decompositions(good: DataFrame, ident: list[str], trials: int, max_modes: int | None) -> DataFrame:
    """(ident, y, scale, parts) of candidates whose trials fit one task: ``parts`` has the modes and then the
    residue, n doubles each; times ``scale`` they add up to ``y``."""
    kinds = ", ".join([*key_schema(good, ident), "y array<double>, scale double, parts array<binary>"])

    def parts_of(y, eps: float, seed: int):
        r, scale, going = _scaled(y)
        parts: list[np.ndarray] = []
        while going:
            k = len(parts)
            if k >= MOST_STAGES:
                raise RuntimeError(f"no end after {k} modes")
            with_noise = [terms[k] for terms in _noise_blocks(seed, len(r), trials) if k < len(terms)]
            size = eps * np.std(r)
            sums = [first_modes(r[None, :] + size * w).sum(0) for w in with_noise]
            noisy = sum(map(len, with_noise))
            alone = first_modes(r[None, :])[0] if noisy < trials else np.zeros(len(r))
            mode, r, going = _next_mode(r, alone, sums, noisy, trials)
            parts.append(mode)
            going = going and (max_modes is None or len(parts) < max_modes)
        return scale, [p.tobytes() for p in (*parts, r)]

    def run(batches):
        keep_heap()
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[[i]].reset_index(drop=True)
                scale, parts = parts_of(row["y"][0], row["epsilon"][0], int(row["seed"][0]))
                yield row.assign(scale=scale, parts=[parts])

    spark = good.sparkSession
    tasks = max(task_partitions(spark), TASK_WAVES * spark.sparkContext.defaultParallelism)
    dealt = good.repartition(tasks, *ident[:-2]).sortWithinPartitions(F.size("y"), "seed")  # noise changes seldom
    return dealt.mapInPandas(run, kinds)


def whole_decompositions(series: DataFrame, candidates: DataFrame, trials: int = DEFAULT_TRIALS, max_modes: int | None = None,
                         keys=("series_id",), value: str = "y", t: str = "t", min_len: int = 4) -> DataFrame | None:
    """The successful decompositions of ``ensemble_decompose`` as one row per candidate (keys, cand_id, epsilon,
    seed, y, scale, parts), not stored; None if a series has more points than fit (BLOCK_POINTS over all trials, a chunk of
    rows), a time that repeats or a value that is not finite."""
    keys = list(keys)
    good, _, ident = _candidate_rows(series, candidates, 0.0, 0, keys, value, t, min_len)
    most = min(BLOCK_POINTS // trials, chunk_rows(series.sparkSession))
    sizes = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(t).alias("times"), F.sum(F.col(value) * 0.0).alias("zero"))
    plain = (F.col("n") <= most) & (F.col("times") == F.col("n")) & (F.col("zero") == 0.0)
    if sizes.where(~F.coalesce(plain, F.lit(False))).limit(1).count():
        return None
    return _whole_decompositions(good, ident, trials, max_modes)


def _staged_decompositions(good: DataFrame, ident: list[str], trials: int, max_modes: int | None) -> list[DataFrame]:
    """The states after 0, 1, ... modes of candidates of any length, stage by stage."""
    spark = good.sparkSession
    state_schema = ", ".join([*key_schema(good, ident), "n long, scale double, r binary, mode binary, going boolean"])

    def begin(batches):
        for pdf in batches:
            out = []
            for y in pdf["y"]:
                x, scale, going = _scaled(y)
                out.append((len(x), scale, x.tobytes(), None, going))
            extra = pd.DataFrame(out, columns=["n", "scale", "r", "mode", "going"])
            yield pd.concat([pdf[ident].reset_index(drop=True), extra], axis=1)

    states = [cut_lineage(good.mapInPandas(begin, state_schema))]
    if not states[0].where("going").limit(1).count():
        return states
    lengths = states[0].where("going").select("seed", "n").distinct()
    noise = cut_lineage(_noise_table(lengths, trials))
    small = 8 * trials * (lengths.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_BYTES
    while states[-1].where("going").limit(1).count():
        k = len(states) - 1
        if k >= MOST_STAGES:
            raise RuntimeError(f"no end after {k} modes")
        states.append(_stage(states[-1].where("going"), noise.where(F.col("k") == k), ident, state_schema, trials,
                             max_modes is not None and k + 1 >= max_modes, small))
    return states


def _noise_table(lengths: DataFrame, trials: int) -> DataFrame:
    """(seed, n, first, k, count, w): the k-th noise terms of a block of trials, as
    [count, n] doubles; once per (seed, length), shared by all series and candidates."""
    spark = lengths.sparkSession
    sizes = F.greatest(F.lit(1), F.least(F.lit(-(-trials // TRIAL_BLOCKS)), F.floor(F.lit(BLOCK_POINTS) / F.col("n")))).cast("int")
    blocks = lengths.withColumn("size", sizes).withColumn(
        "first", F.explode(F.sequence(F.lit(0), F.lit(trials - 1), F.col("size"))))
    blocks = blocks.withColumn("count", F.least(F.col("size"), F.lit(trials) - F.col("first"))).drop("size")

    def run(batches):
        keep_heap()
        for pdf in batches:
            for seed, n, first, count in pdf[["seed", "n", "first", "count"]].itertuples(index=False):
                terms = _noise_block(int(seed), n, first, count)
                yield pd.DataFrame([(seed, n, first, k, count, t.tobytes()) for k, t in enumerate(terms)],
                                   columns=["seed", "n", "first", "k", "count", "w"])

    return blocks.repartition(task_partitions(spark), "seed", "n", "first").mapInPandas(
        run, "seed long, n long, first int, k int, count int, w binary")


def _stage(state: DataFrame, noise: DataFrame, ident: list[str], schema: str, trials: int, last: bool,
           small: bool) -> DataFrame:
    """The next mode and residue of every candidate that goes on.

    A task has one candidate and one block of trials; blocks without a noise
    term of this number (all their trials have fewer modes) add the plain
    residue's first mode for each of their trials.  ``small`` noise is joined
    after the shuffle, which then moves residues only; candidates share it."""
    spark = state.sparkSession
    cand = [c for c in ident if c not in ("epsilon", "seed")]
    blocks = noise.select("seed", "n", "first", "count", "w")
    plain = state.select(*cand, "seed", "n", F.lit(-1).alias("first"), F.lit(trials).alias("count"),
                         F.lit(None).cast("binary").alias("w"), "epsilon", "r")
    pairs = state.select(*cand, "seed", "n", "epsilon", "r")
    if small:
        work = pairs.join(F.broadcast(blocks.drop("w")), on=["seed", "n"]).unionByName(plain.drop("w"))
        work = work.repartition(task_partitions(spark), *cand, "first").join(
            F.broadcast(blocks.drop("count")), on=["seed", "n", "first"], how="left")
    else:
        work = pairs.join(blocks, on=["seed", "n"]).unionByName(plain).repartition(task_partitions(spark), *cand, "first")
    head = ", ".join(key_schema(state, cand))

    def sift(batches):
        keep_heap()
        for pdf in batches:
            out = []
            for r, w, eps, count, first in pdf[["r", "w", "epsilon", "count", "first"]].itertuples(index=False):
                r = np.frombuffer(r, float)
                if first < 0:
                    total = first_modes(r[None, :])[0]
                else:
                    noisy = r[None, :] + eps * np.std(r) * np.frombuffer(w, float).reshape(count, -1)
                    total = first_modes(noisy).sum(0)
                out.append((first, count, total.tobytes()))
            extra = pd.DataFrame(out, columns=["first", "count", "total"])
            yield pd.concat([pdf[cand].reset_index(drop=True), extra], axis=1)

    sums = work.mapInPandas(sift, f"{head}, first int, count int, total binary").groupBy(*cand).agg(
        F.array_sort(F.collect_list(F.struct("first", "count", "total"))).alias("_sums"))

    def finish(batches):
        for pdf in batches:
            r_new, modes, going = [], [], []
            for r, sums in zip(pdf["r"], pdf["_sums"]):
                r = np.frombuffer(r, float)
                parts = {s["first"]: (s["count"], np.frombuffer(s["total"], float)) for s in sums}
                alone = parts.pop(-1)[1]
                noisy = sum(c for c, _ in parts.values())
                mode, rest, more = _next_mode(r, alone, [parts[first][1] for first in sorted(parts)], noisy, trials)
                modes.append(mode.tobytes())
                r_new.append(rest.tobytes())
                going.append(more and not last)
            out = pdf[[*ident, "n", "scale"]].reset_index(drop=True)
            yield out.assign(r=r_new, mode=modes, going=going)

    return cut_lineage(state.select(*ident, "n", "scale", "r").join(sums, on=cand).mapInPandas(finish, schema))


def components_of(decomp: DataFrame, keys=("series_id",)) -> DataFrame:
    """Successful component rows in the canonical long layout, keyed by candidate."""
    return decomp.where(F.col("status") == "Success").select(*keys, "cand_id", "t", "component", "k", "value")


def decomposition_residual(decomp: DataFrame, series: DataFrame, keys=("series_id",), t: str = "t") -> DataFrame:
    """signal - sum of modes per (series, candidate, t)."""
    keys = list(keys)
    modes = components_of(decomp, keys).where(F.col("component") != "residual")
    s = modes.groupBy(*keys, "cand_id", t).agg(F.sum("value").alias("_m"))
    return s.join(series.select(*keys, t, "y"), on=[*keys, t]).select(
        *keys, "cand_id", t, (F.col("y") - F.col("_m")).alias("residual"))


def batch_status(decomp: DataFrame, series: DataFrame, keys=("series_id",), t: str = "t") -> DataFrame:
    """One row per (series, candidate): status, message, length, number of modes."""
    keys = list(keys)
    n = series_length(series, keys, t, "data_length")
    st = decomp.groupBy(*keys, "cand_id").agg(
        F.first("epsilon").alias("epsilon"), F.first("status").alias("status"),
        F.first("error_message", ignorenulls=True).alias("error_message"),
        F.countDistinct(F.when(F.col("component").startswith("IMF_"), F.col("component"))).cast("long").alias("num_imfs"))
    return st.join(n, on=keys, how="left")


def batch_summary(decomp: DataFrame, series: DataFrame, strategy: str = "predictive", keys=("series_id",),
                  t: str = "t") -> DataFrame:
    """``batch_status`` with the scores of each decomposition: orthogonality index,
    rrmse (by std), predictive quality, signal energy, strategy, noise type (G21).

    A failed series keeps its row: its scores are null, its strategy is ``N/A``.
    ``decomp`` is read more than once: pass a written or checkpointed table."""
    from tidemark.operators import quality as qa

    ck = [*keys, "cand_id"]
    comps = components_of(decomp, keys)
    signal = series.select(*keys, t, "y").join(comps.select(*ck).distinct(), on=list(keys))
    scores = qa.series_stats(comps, signal, ck, t).select(
        *ck, qa.oi_col().alias("orthogonality_index"), qa.rrmse_std_col().alias("rrmse"),
        F.col("e_signal").alias("signal_energy"))
    scores = scores.join(qa.predictive_quality(comps, signal, ck), on=ck, how="left")
    done = F.col("status") == "Success"
    return batch_status(decomp, series, keys, t).join(scores, on=ck, how="left").withColumn(
        "strategy", F.when(done, F.lit(strategy)).otherwise(F.lit("N/A"))).withColumn(
        "noise_type", F.when(done, F.lit("Laplace_White_Noise")))


def trend_decompose(series: DataFrame, alpha, epsilon: float = DEFAULT_EPSILON, trials: int = DEFAULT_TRIALS,
                    seed: int = DEFAULT_SEED, max_modes: int | None = None, keys=("series_id",), t: str = "t") -> DataFrame:
    """Zero-phase smoothed trend, then ensemble decomposition of the rest.

    Long output: ``trend``, ``smoothing_residual`` and the decomposition of the
    smoothing residual (IMF_k and ``residual``), with status columns."""
    from tidemark.operators.smoothing import detrend, zero_phase_trend

    keys = list(keys)
    tr = detrend(zero_phase_trend(series.select(*keys, t, "y"), alpha, keys=keys, t=t), out="_sr")
    rest = tr.select(*keys, t, F.col("_sr").alias("y"))
    dec = ensemble_decompose(rest, None, trials, epsilon, seed, max_modes, keys, "y", t)
    extra = tr.select(*keys, F.lit(0).cast("long").alias("cand_id"), F.lit(float(epsilon)).alias("epsilon"),
                      F.lit(int(seed)).cast("long").alias("seed"), t,
                      F.explode(F.array(
                          F.struct(F.lit("trend").alias("component"), F.lit(-1).cast("long").alias("k"), F.col("trend").alias("value")),
                          F.struct(F.lit("smoothing_residual").alias("component"), F.lit(0).cast("long").alias("k"), F.col("_sr").alias("value")),
                      )).alias("_c")).select(*keys, "cand_id", "epsilon", "seed", t, "_c.*",
                                             F.lit("Success").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return dec.unionByName(extra)


def status_counts(status: DataFrame) -> DataFrame:
    """Number of series per status (the success count of a batch)."""
    return status.groupBy("status").agg(F.count(F.lit(1)).cast("long").alias("n_series"))
