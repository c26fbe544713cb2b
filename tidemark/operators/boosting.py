"""Gradient-boosted regression trees on quantile-binned columns.

Columns are cut at their quantiles, rows become small integers, and a tree
grows level by level from histograms of gradients: per node, column and bin
the rows and the gradient sums.  Gradients are whole numbers (fixed point), so
the sums are exact and a model does not depend on how rows are dealt to tasks.

Rows that fit one task (``task_rows``) are sent to one task per fit, all fits
side by side.  More rows stay in blocks: every level is one Spark aggregation
of the blocks' histograms for all fits together.  Both give the same trees.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

TASK_ROWS = 1 << 20  # training and validation rows that one task holds
BLOCK_ROWS = 1 << 17  # rows of a block when there are more
STATE_ROUNDS = 16  # rounds after which blocks store their forecasts anew
GRADIENT_BITS = 24  # sums of 2 ** 29 rows are exact in a double
PATIENCE = 50  # rounds without improvement after which boosting stops


@dataclass(frozen=True)
class BoostParams:
    """Parameters of one fit; the defaults below the first two are fixed values."""
    rate: float = 0.1
    trees: int = 100
    seed: int = 42
    depth: int = 8
    row_share: float = 0.6018511082680795
    tree_columns: float = 0.9991332660884722
    level_columns: float = 0.9899263233933308
    l1: float = 2.0091241453174424e-07
    l2: float = 0.6986580166614497
    gamma: float = 1.0420513361631241e-07
    min_rows: int = 17

    def check(self) -> None:
        if not (0 < self.rate <= 1 and self.trees >= 1 and 1 <= self.depth <= 15 and 0 < self.row_share <= 1
                and self.l2 >= 0 and self.l1 >= 0 and self.gamma >= 0 and self.min_rows >= 1):
            raise ValueError(f"booster parameters out of range: {self}")


@dataclass
class Tree:
    """Nodes numbered as in a heap: children of i are 2 i + 1 (bin <= cut) and 2 i + 2; column -1 marks a leaf."""
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # nodes x outputs
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows, flat = np.arange(len(bins)), bins.ravel()
        while len(rows):
            node = at[rows]
            column = self.column[node]
            inner = column >= 0
            if not inner.all():
                rows, node, column = rows[inner], node[inner], column[inner]
            at[rows] = 2 * node + 1 + (flat[rows * bins.shape[1] + column] > self.cut[node])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class Booster:
    """A fitted model: the forecast of ``outputs`` steps from the columns ``features``."""
    features: list[str]
    edges: list[np.ndarray]
    steps: list[int]
    params: BoostParams
    base: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # validation mean squared error after each round
    status: str = "ok"

    def first(self, n: int) -> "Booster":
        """The model of the first ``n`` trees: that of the same fit with ``n`` rounds."""
        return replace(self, trees=self.trees[:n], losses=self.losses[:n])

    def stopped(self, patience: int = PATIENCE) -> "Booster":
        """The trees up to the smallest validation loss, looking ``patience`` rounds past it (R2)."""
        return self.first(best_round(self.losses, patience)) if self.losses else self

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for tree in self.trees:
            out += tree.predict(bins)
        return out

    @property
    def importance(self) -> np.ndarray:
        """Each column's share of the gain of all splits (0 without a split)."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.column >= 0
            np.add.at(total, t.column[inner], t.gain[inner])
        return total / total.sum() if total.sum() > 0 else total


def best_round(losses, patience: int = PATIENCE) -> int:
    """Number of rounds up to the smallest loss, looking at most ``patience`` rounds past it (R2)."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


# --- one tree from histograms ---------------------------------------------------

def _uniform(seed: int, turn: int, ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD6E8FEB86659FD93) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sampled_rows(p: BoostParams, turn: int, ids: np.ndarray) -> np.ndarray:
    return _uniform(p.seed, 2 * turn, ids) < p.row_share


def sampled_columns(p: BoostParams, turn: int, level: int, n: int) -> np.ndarray:
    """Columns a level may split on: a share of those its tree may use."""
    tree = np.argsort(_uniform(p.seed, 2 * turn + 1, np.arange(n)), kind="stable")[:max(1, int(n * p.tree_columns))]
    order = np.argsort(_uniform(p.seed + 1 + level, 2 * turn + 1, tree), kind="stable")
    return np.sort(tree[order[:max(1, int(len(tree) * p.level_columns))]])


def _score(g: np.ndarray, n: np.ndarray, p: BoostParams) -> np.ndarray:
    """Second-order score of gradient sums ``g`` (outputs first) over ``n`` rows, summed over the outputs."""
    total = None
    for v in g:
        part = np.abs(v)
        part -= p.l1
        np.maximum(part, 0, out=part)
        part *= part
        total = part if total is None else np.add(total, part, out=total)
    total /= n + max(p.l2, 1e-300)
    return total


def best_splits(n: np.ndarray, g: np.ndarray, columns: np.ndarray, p: BoostParams):
    """(gain, column, cut, left rows, left sums) per node from histograms n[node, column, bin] and g[output, node,
    column, bin]; gain 0 where no allowed split gains more than gamma.  Ties: the first column, then the first cut."""
    left_n, left_g = n.cumsum(axis=2), g.cumsum(axis=3)
    all_n, all_g = left_n[:, :1, -1:], left_g[:, :, :1, -1:]
    right_n = all_n - left_n
    gain = _score(left_g, left_n, p)
    gain += _score(all_g - left_g, right_n, p)
    gain -= _score(all_g, all_n, p)
    gain[np.minimum(left_n, right_n) < p.min_rows] = 0
    if len(columns) < gain.shape[1]:
        gain[:, np.setdiff1d(np.arange(gain.shape[1]), columns)] = 0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    nodes = np.arange(len(gain))
    best = flat[nodes, at]
    column, cut = np.divmod(at, gain.shape[2])
    best = np.where(best > p.gamma, best, 0)
    return best, column, cut, left_n[nodes, column, cut], left_g[:, nodes, column, cut].T


def histogram(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, g: np.ndarray, nodes: int, width: int):
    """Row counts and gradient sums by (node, column, bin) of ``rows``, positions in ``bins`` (columns first).
    One column at a time: its cells and its keys stay in the processor's cache."""
    n, sums = np.empty((nodes, len(bins), width)), np.empty((g.shape[1], nodes, len(bins), width))
    start, cells = node * width, nodes * width
    at = np.empty_like(start)
    weights = [np.ascontiguousarray(v) for v in g.T]
    for c, column in enumerate(bins):
        np.add(start, column.take(rows), out=at)
        n[:, c] = np.bincount(at, minlength=cells).reshape(nodes, width)
        for k, w in enumerate(weights):
            sums[k, :, c] = np.bincount(at, w, cells).reshape(nodes, width)
    return n, sums


class Grower:
    """One tree, level by level; ``open`` are the nodes whose histograms are wanted next."""

    def __init__(self, p: BoostParams, turn: int, outputs: int, columns: int):
        size = (1 << (p.depth + 1)) - 1
        self.p, self.turn, self.columns, self.level = p, turn, columns, 0
        self.tree = Tree(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros((size, outputs)), np.zeros(size))
        self.open = np.array([0])
        self.rows = np.zeros(size)  # sampled rows of each node that was made

    def split(self, n: np.ndarray, g: np.ndarray, unit: float) -> None:
        """Splits the open nodes by their histograms (gradients in units of ``unit``)."""
        p, tree = self.p, self.tree
        g = g * unit
        if self.level == 0:
            self._leaf(self.open, n[:, 0].sum(axis=1), g[:, :, 0].sum(axis=2).T)
        gain, column, cut, left_n, left_g = best_splits(n, g, sampled_columns(p, self.turn, self.level, self.columns), p)
        done = gain > 0
        node = self.open[done]
        tree.column[node], tree.cut[node], tree.gain[node] = column[done], cut[done], gain[done]
        all_n, all_g = n[done][:, 0].sum(axis=1), g[:, done, 0].sum(axis=2).T
        left, right = 2 * node + 1, 2 * node + 2
        self._leaf(left, left_n[done], left_g[done])
        self._leaf(right, all_n - left_n[done], all_g - left_g[done])
        self.level += 1
        rows = np.concatenate([left_n[done], all_n - left_n[done]])
        children = np.concatenate([left, right])
        self.rows[children] = rows
        self.open = np.sort(children[rows >= 2 * p.min_rows]) if self.level < p.depth else children[:0]

    def _leaf(self, node: np.ndarray, n: np.ndarray, g: np.ndarray) -> None:
        shrunk = np.sign(g) * np.maximum(np.abs(g) - self.p.l1, 0)
        self.tree.value[node] = -self.p.rate * shrunk / np.maximum(n + self.p.l2, 1e-300)[:, None]


def gradient_unit(y: np.ndarray, base: np.ndarray) -> float:
    """The fixed-point unit: a power of two such that the first gradients have GRADIENT_BITS bits."""
    most = float(np.abs(y - base).max()) if y.size else 0.0
    return 2.0 ** (np.ceil(np.log2(most)) - GRADIENT_BITS) if most > 0 else 1.0


def gradients(pred: np.ndarray, y: np.ndarray, unit: float) -> np.ndarray:
    return np.rint((pred - y) / unit)


def boost(bins: np.ndarray, y: np.ndarray, ids: np.ndarray, p: BoostParams, width: int, base: np.ndarray, unit: float,
          val_bins: np.ndarray | None = None, val_y: np.ndarray | None = None, patience: int | None = None):
    """(trees, validation losses): ``p.trees`` rounds over rows in memory; with
    ``patience`` rounds end when the loss has not improved for so many."""
    columns, outputs = bins.shape[1], y.shape[1]
    pred = np.tile(base, (len(y), 1))
    held = np.tile(base, (len(val_y), 1)) if val_y is not None else None
    trees, losses, best = [], [], 0
    for turn in range(p.trees):
        sampled = sampled_rows(p, turn, ids)
        take, rest_rows = np.flatnonzero(sampled), np.flatnonzero(~sampled)
        own, g = bins[take], gradients(pred[take], y[take], unit)
        own_bins, by_column = own.ravel(), np.ascontiguousarray(own.T)
        grower = Grower(p, turn, outputs, columns)
        at = np.zeros(len(take), np.int64)  # node of each sampled row
        live = np.arange(len(take))  # sampled rows in open nodes
        above = None  # the level above: its nodes' slots, counts and sums
        while len(grower.open):
            nodes = grower.open
            slot = np.full(len(grower.tree.column), -1)
            slot[nodes] = np.arange(len(nodes))
            live = live[slot[at[live]] >= 0]
            # of two open siblings only the one with fewer rows is counted, the other is the parent's rest
            twin = np.where(nodes % 2 == 1, nodes + 1, nodes - 1)
            twin[nodes == 0] = 0
            rest = (slot[twin] >= 0) & (nodes > 0)
            rest &= (grower.rows[nodes] > grower.rows[twin]) | ((grower.rows[nodes] == grower.rows[twin]) & (nodes % 2 == 0))
            counted = np.full(len(slot), -1)
            counted[nodes[~rest]] = np.arange((~rest).sum())
            here = live[counted[at[live]] >= 0]
            part_n, part_g = histogram(by_column, here, counted[at[here]], g[here], int((~rest).sum()), width)
            if rest.any():
                n, sums = np.empty((len(nodes), columns, width)), np.empty((outputs, len(nodes), columns, width))
                n[~rest], sums[:, ~rest] = part_n, part_g
                parent, other = above[0][(nodes[rest] - 1) // 2], counted[twin[rest]]
                n[rest] = above[1][parent] - part_n[other]
                sums[:, rest] = above[2][:, parent] - part_g[:, other]
            else:
                n, sums = part_n, part_g
            above = slot, n, sums
            grower.split(n, sums, unit)
            node = at[live]
            column = grower.tree.column[node]
            step = 2 * node + 1 + (own_bins[live * columns + column] > grower.tree.cut[node])
            at[live] = np.where(column >= 0, step, node)
        tree = grower.tree
        trees.append(tree)
        pred[take] += tree.value[at]
        pred[rest_rows] += tree.predict(bins[rest_rows])
        if held is not None:
            held += tree.predict(val_bins)
            losses.append(float(((held - val_y) ** 2).mean()))
            if losses[-1] < losses[best]:
                best = turn
            elif patience is not None and turn - best >= patience:
                break
    return trees, losses


# --- rows as blocks -----------------------------------------------------------------

def quantile_edges(train: DataFrame, features: list[str], width: int) -> list[np.ndarray]:
    """Ascending cuts of every column: at most ``width`` - 1 quantiles of its values; bin = cuts below the value."""
    share = [k / width for k in range(1, width)]
    values = [F.col(f"`{c}`").cast("double") for c in features]
    row = train.agg(*[F.percentile_approx(F.when(v * 0.0 == 0.0, v), share, 10_000).alias(f"c{k}")
                      for k, v in enumerate(values)]).first()
    return [np.unique(np.array(v or [], float)) for v in row]


def to_bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    kind = np.uint8 if all(len(e) < 256 for e in edges) else np.uint16
    if not columns:
        return np.zeros((0, 0), kind)
    return np.stack([np.searchsorted(e, v, "left") for v, e in zip(columns, edges)], axis=1).astype(kind)


def _plain(names: list[str]) -> list:
    """Columns under names without dots, which mapInArrow cannot resolve.  Other names stay: Catalyst's
    constraints grow steeply with the number of aliases."""
    return [F.col(f"`{c}`").alias(f"_c{k}") if "." in c else F.col(f"`{c}`") for k, c in enumerate(names)]


def _numbers(column: pa.Array) -> np.ndarray:
    """A numeric column as doubles, NaN for null."""
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


BLOCK = "held boolean, id long, n long, blob binary"


def pack_blocks(df: DataFrame, features, targets, edges, held: bool, block_rows: int) -> DataFrame:
    """Blocks (held, id, n, blob): row ids, bins and targets of up to ``block_rows``
    rows; rows with a null or non-finite feature or target are left out."""
    names = list(dict.fromkeys([*features, *targets]))
    rows = df.select(F.xxhash64("series_id", "t").alias("_row"), *_plain(names))
    places = [[1 + names.index(c) for c in group] for group in (features, targets)]

    def block(parts):
        ids, x, y = (np.concatenate(v) for v in zip(*parts))
        blob = pickle.dumps((ids, to_bins(list(x.T), edges), y), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([int(ids.min())]), pa.array([len(ids)]),
                                           pa.array([blob], pa.binary())], names=["held", "id", "n", "blob"])

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            x, y = (np.stack([_numbers(batch.column(k)) for k in ks], axis=1) for ks in places)
            good = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
            ids, x, y = batch.column(0).to_numpy()[good], x[good], y[good]
            for at in range(0, len(ids), block_rows):
                part = tuple(v[at:at + block_rows] for v in (ids, x, y))
                if n + len(part[0]) > block_rows:
                    yield block(kept)
                    kept, n = [], 0
                kept.append(part)
                n += len(part[0])
        if n:
            yield block(kept)

    return rows.mapInArrow(run, BLOCK)


def _start(blocks: DataFrame, outputs: int) -> tuple[int, np.ndarray, float]:
    """Training rows, mean targets and the fixed-point unit over all blocks."""
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                y = pickle.loads(blob)[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(y)]), pa.array([y.sum(axis=0).tolist()], pa.list_(pa.float64())),
                     pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())),
                     pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64()))], names=["n", "s", "a", "b"])

    parts = blocks.where("NOT held").select("blob").mapInArrow(
        run, "n long, s array<double>, a array<double>, b array<double>")
    row = parts.agg(F.sum("n"), *[F.sum(F.col("s")[k]) for k in range(outputs)], *[F.min(F.col("a")[k]) for k in range(outputs)],
                    *[F.max(F.col("b")[k]) for k in range(outputs)]).first()
    n = int(row[0] or 0)
    if not n:
        return 0, np.zeros(outputs), 1.0
    base = np.array(row[1:1 + outputs], float) / n
    ends = np.array(row[1 + outputs:], float).reshape(2, outputs)
    return n, base, gradient_unit(ends, base)


@dataclass
class Fit:
    """One model to be fitted: the target columns it forecasts together, and its parameters."""
    outputs: list[int]
    params: BoostParams


def fit_boosters(train: DataFrame, val: DataFrame | None, features, targets: list[str], fits: list[Fit],
                 patience: int | None = None, width: int = 64, task_rows: int = TASK_ROWS) -> list[Booster]:
    """A booster for every fit (``outputs``: positions in ``targets``; several
    share each tree's splits, with vectors in its leaves).

    Rows need ``series_id`` and ``t`` (they name a row in the draws of row
    samples); rows with a null or non-finite feature or target count for
    nothing.  ``val`` rows give the loss after each round, ``patience`` stops by
    it.  A table without usable rows gives models without trees that forecast 0.
    """
    for fit in fits:
        fit.params.check()
    features = list(features)
    edges = quantile_edges(train, features, width)
    blocks = pack_blocks(train, features, targets, edges, False, BLOCK_ROWS)
    if val is not None:
        blocks = blocks.unionByName(pack_blocks(val, features, targets, edges, True, BLOCK_ROWS))
    blocks = cut_lineage(blocks)
    n, base, unit = _start(blocks, len(targets))
    made = [Booster(features, edges, [o + 1 for o in f.outputs], f.params, base[f.outputs]) for f in fits]
    if n == 0:
        return made
    rows = blocks.agg(F.sum("n")).first()[0]
    grown = _by_task(blocks, fits, made, unit, width, patience) if rows <= task_rows else \
        _by_level(blocks, fits, made, unit, width, patience)
    for booster, (trees, losses) in zip(made, grown):
        booster.trees, booster.losses = trees, losses
    return made


def _by_task(blocks: DataFrame, fits, made, unit: float, width: int, patience: int | None):
    """Every fit in a task of its own over all rows (at most ``task_rows``)."""
    todo = [(f.outputs, f.params, b.base) for f, b in zip(fits, made)]

    def fit(number: int, blobs: list[tuple[bool, bytes]]):
        outputs, params, base = todo[number]
        sets = []
        for held in (False, True):
            parts = [pickle.loads(b) for h, b in blobs if h == held]
            sets.append([np.concatenate(v) for v in zip(*parts)] if parts else None)
        (ids, bins, y), held = sets
        trees, losses = boost(bins, y[:, outputs], ids, params, width, base, unit,
                              *((held[1], held[2][:, outputs]) if held else (None, None)), patience)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pickle.dumps((trees, losses), protocol=5)])],
                                          names=["fit", "model"])

    def run(batches):
        number, blobs = None, []
        for batch in batches:
            for at, held, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if at != number and blobs:
                    yield fit(number, blobs)
                    blobs = []
                number = at
                blobs.append((held, blob))
        if blobs:
            yield fit(number, blobs)

    sent = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(fits) - 1).cast("long"))).alias("fit"),
                         "held", "id", "blob")
    sent = sent.repartitionByRange(len(fits), "fit").sortWithinPartitions("fit", "held", "id")
    found = sent.select("fit", "held", "blob").mapInArrow(run, "fit long, model binary").collect()
    return [pickle.loads(r["model"]) for r in sorted(found, key=lambda r: r["fit"])]


def _by_level(blocks: DataFrame, fits, made, unit: float, width: int, patience: int | None):
    """All fits together, one aggregation of the blocks' histograms per level.

    A block's forecasts are stored every STATE_ROUNDS rounds; in between they
    follow from the trees since then.  Tasks send, per fit, node and column, the
    counts and sums of its bins; the reducers add them up."""
    columns = len(made[0].features)
    grown = [([], []) for _ in fits]
    best = [0] * len(fits)
    live = list(range(len(fits)))
    state, since = _store(blocks, fits, made, [[] for _ in fits]), [[] for _ in fits]
    for turn in range(max(f.params.trees for f in fits)):
        live = [k for k in live if turn < fits[k].params.trees]
        if not live:
            break
        growers = {k: Grower(fits[k].params, turn, len(fits[k].outputs), columns) for k in live}
        while any(len(g.open) for g in growers.values()):
            for k, (n, sums) in _level(state, fits, growers, since, unit, columns, width).items():
                growers[k].split(n, sums, unit)
        for k in live:
            grown[k][0].append(growers[k].tree)
            since[k].append(growers[k].tree)
        for k, loss in _losses(state, fits, since, live).items():
            grown[k][1].append(loss)
            if loss < grown[k][1][best[k]]:
                best[k] = turn
        if patience is not None:
            live = [k for k in live if not grown[k][1] or turn - best[k] < patience]
        if (turn + 1) % STATE_ROUNDS == 0:
            state, since = _store(state, fits, made, since), [[] for _ in fits]
    return grown


def _forecasts(blob: bytes, since) -> tuple:
    ids, bins, y, preds = pickle.loads(blob)
    for k, trees in enumerate(since):
        for tree in trees:
            preds[k] = preds[k] + tree.predict(bins)
    return ids, bins, y, preds


def _store(blocks: DataFrame, fits, made, since) -> DataFrame:
    bases = [b.base for b in made]

    def run(batches):
        for batch in batches:
            out = []
            for blob in batch.column(3).to_pylist():
                data = pickle.loads(blob)
                if len(data) == 3:
                    data = (*data, [np.tile(b, (len(data[0]), 1)) for b in bases])
                    blob = pickle.dumps(data, protocol=5)
                out.append(pickle.dumps(_forecasts(blob, since), protocol=5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=batch.schema.names)

    return cut_lineage(blocks.mapInArrow(run, BLOCK))


def _level(state: DataFrame, fits, growers, since, unit, columns, width) -> dict:
    sent = {k: (g.p, g.turn, g.tree, g.open) for k, g in growers.items() if len(g.open)}
    outputs = {k: fits[k].outputs for k in sent}

    def run(batches):
        total = {}
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids, bins, y, preds = _forecasts(blob, since)
                by_column = np.ascontiguousarray(bins.T)
                for k, (p, turn, tree, nodes) in sent.items():
                    take = np.flatnonzero(sampled_rows(p, turn, ids))
                    at = tree.leaves(bins[take])
                    slot = np.full(len(tree.column), -1)
                    slot[nodes] = np.arange(len(nodes))
                    here = slot[at] >= 0
                    rows = take[here]
                    g = gradients(preds[k][rows], y[rows][:, outputs[k]], unit)
                    n, sums = histogram(by_column, rows, slot[at[here]], g, len(nodes), width)
                    whole = np.concatenate([n[None], sums]).astype(np.int64)
                    total[k] = total[k] + whole if k in total else whole
        for k, whole in total.items():
            _, nodes, cols, _ = whole.shape
            cells = whole.transpose(1, 2, 0, 3).reshape(nodes * cols, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), k)), pa.array(np.arange(len(cells))),
                 pa.array([c.astype("<i8").tobytes() for c in cells], pa.binary())], names=["fit", "cell", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<i8") for b in table.column("sums").to_pylist())
        return pa.table({"fit": table.column("fit")[:1], "cell": table.column("cell")[:1],
                         "sums": pa.array([total.tobytes()], pa.binary())})

    parts = state.where("NOT held").select("blob").mapInArrow(run, "fit long, cell long, sums binary")
    found = parts.groupBy("fit", "cell").applyInArrow(add, "fit long, cell long, sums binary").collect()
    out = {}
    for k, (_, _, _, nodes) in sent.items():
        h = len(outputs[k])
        whole = np.zeros((len(nodes) * columns, (h + 1) * width))
        for r in found:
            if r["fit"] == k:
                whole[r["cell"]] = np.frombuffer(r["sums"], "<i8")
        whole = whole.reshape(len(nodes), columns, h + 1, width).transpose(2, 0, 1, 3)
        out[k] = whole[0], whole[1:]
    return out


def _losses(state: DataFrame, fits, since, live) -> dict[int, float]:
    outputs = [f.outputs for f in fits]

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                _, _, y, preds = _forecasts(blob, since)
                sums = [float(((preds[k] - y[:, outputs[k]]) ** 2).sum()) for k in live]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(live, pa.int64()), pa.array(sums), pa.array([preds[k].size for k in live], pa.int64())],
                    names=["fit", "s", "n"])

    rows = state.where("held").select("blob").mapInArrow(run, "fit long, s double, n long")
    return {r["fit"]: r["s"] / r["n"] for r in rows.groupBy("fit").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}


# --- forecasts --------------------------------------------------------------------------

def predict_boosters(boosters: list[Booster], df: DataFrame, keys=("series_id", "t"), extra=(),
                     counts: list[list[int]] | None = None) -> DataFrame:
    """Long forecasts (keys, extra, model, trees, step, y_pred) of every booster;
    ``counts``: numbers of trees to forecast after, per booster (default: all).
    Rows with a null or non-finite feature are left out."""
    features = boosters[0].features
    counts = counts or [[len(b.trees)] for b in boosters]
    kept = [*keys, *extra]
    columns = list(dict.fromkeys([*kept, *features]))
    rows = df.select(*_plain(columns))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema)
    names = [*kept, "model", "trees", "step", "y_pred"]

    def run(batches):
        for batch in batches:
            x = [_numbers(batch.column(columns.index(c))) for c in features]
            good = np.isfinite(np.stack(x, axis=1)).all(axis=1) if features else np.ones(batch.num_rows, bool)
            own = [c.filter(pa.array(good)) for c in batch.columns[:len(kept)]]
            bins = to_bins([v[good] for v in x], boosters[0].edges)
            for number, (b, wanted) in enumerate(zip(boosters, counts)):
                pred = np.tile(b.base, (len(bins), 1))
                done = 0
                for count in sorted(set(wanted)):
                    for tree in b.trees[done:count]:
                        pred += tree.predict(bins)
                    done = count
                    for h, step in enumerate(b.steps):
                        yield pa.RecordBatch.from_arrays(
                            [*own, *[pa.array(np.full(len(bins), v), pa.int64()) for v in (number, count, step)],
                             pa.array(pred[:, h])], names=names)

    return rows.mapInArrow(run, f"{types}, model long, trees long, step long, y_pred double")
