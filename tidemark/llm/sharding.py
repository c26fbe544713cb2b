"""Shards of near-equal size from sampled splitters.

Records are ordered by (content hash, id hash, row number).  Keys drawn with a
chance in proportion to their record's size give quantile boundaries; records
are range-partitioned by them, the ranges are measured, and every overfull
range is sampled again by itself until none is left.  A heavy key gets a range
of its own, which is cut further by id and at last by row, so copies that hold
a third of all rows are spread.  The measured ranges, many to a shard, are then
dealt to the shards, largest first.

Only range sizes and samples reach the driver; their number follows
``shards * parts * oversample``, not the data.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, prepare, written

PARTS = 256  # ranges a shard is made of, about
OVERSAMPLE = 8  # expected sampled keys per range
EXTRA = 8  # bytes that a record takes besides its text
ROW_KEY = "_shard_k3"
KEYS = ["_shard_k1", "_shard_k2", ROW_KEY]
SIZE = "_shard_size"


def joined_keys(k: np.ndarray) -> np.ndarray:
    """Three unsigned integers per row as 24 bytes that compare alike."""
    return np.ascontiguousarray(k.astype(">u8")).view("S24").reshape(-1)


def _key(parts) -> bytes:
    return b"".join(int(p).to_bytes(8, "big") for p in parts)


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    """(n x 3 unsigned keys, sizes) of a batch of (k1, k2, k3, size)."""
    k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in range(3)], axis=1)
    return k, batch.column(3).to_numpy(zero_copy_only=False)


def _ranges(k: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, joined_keys(k), "right") if len(bounds) else np.zeros(len(k), np.int64)


@dataclass
class Range:
    number: int
    size: int
    rows: int
    low: tuple[int, int]  # least and greatest of the first two key parts
    high: tuple[int, int]

    @property
    def level(self) -> int:
        """Key part by which the range can be cut."""
        return 0 if self.low[0] != self.high[0] else 1 if self.low[1] != self.high[1] else 2


def measure(records: DataFrame, bounds: list[bytes]) -> list[Range]:
    """Size, rows and extreme keys of every range that holds a record."""
    cuts = np.array(bounds, "S24")

    def run(batches):
        n = len(cuts) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full((n, 2), np.iinfo(np.uint64).max, np.uint64), np.zeros((n, 2), np.uint64)
        for batch in batches:
            k, weight = _columns(batch)
            r = _ranges(k, cuts)
            np.add.at(size, r, weight)
            rows += np.bincount(r, minlength=n)
            np.minimum.at(low, r, k[:, :2])
            np.maximum.at(high, r, k[:, :2])
        r = np.flatnonzero(rows)
        # shifted so that signed and unsigned order agree
        ends = [(e[r, c] ^ np.uint64(1 << 63)).view(np.int64) for e in (low, high) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (r, size[r], rows[r], *ends)],
                                         names=["r", "size", "n", "a", "b", "c", "d"])

    found = records.select(*KEYS, SIZE).mapInArrow(run, "r long, size long, n long, a long, b long, c long, d long")
    found = found.groupBy("r").agg(F.sum("size"), F.sum("n"), F.min("a"), F.min("b"), F.max("c"), F.max("d"))
    half = 1 << 63
    return [Range(v[0], v[1], v[2], (v[3] + half, v[4] + half), (v[5] + half, v[6] + half))
            for v in sorted(tuple(row) for row in found.collect())]


def sample(records: DataFrame, bounds: list[bytes], rates: dict[int, float], seed: int) -> dict[int, list]:
    """Per range of ``rates``: (key parts, weight) of records drawn with chance min(1, size * rate)."""
    cuts = np.array(bounds, "S24")
    rate = np.zeros(len(bounds) + 1)
    for r, v in rates.items():
        rate[r] = v

    def run(batches):
        for batch in batches:
            k, size = _columns(batch)
            r = _ranges(k, cuts)
            chance = size * rate[r]
            h = mix(k[:, 0] + mix(k[:, 1] + mix(k[:, 2] + np.uint64(seed))))
            take = (h >> np.uint64(11)).astype(float) / (1 << 53) < chance
            weight = size[take] / np.minimum(chance[take], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[take]), *[pa.array(k[take, c].view(np.int64)) for c in range(3)], pa.array(weight)],
                names=["r", "a", "b", "c", "w"])

    out: dict[int, list] = {r: [] for r in rates}
    for v in records.select(*KEYS, SIZE).mapInArrow(run, "r long, a long, b long, c long, w double").collect():
        out[v["r"]].append((tuple(v[c] & 0xFFFFFFFFFFFFFFFF for c in "abc"), v["w"]))
    return {r: sorted(rows) for r, rows in out.items()}


def quantiles(rows: list, pieces: int, level: int) -> set[bytes]:
    """Boundaries that cut the sampled weight into ``pieces``, on borders of the
    first ``level`` + 1 key parts; a key that spans a whole piece is closed off on both sides."""
    out, total, seen, k = set(), sum(w for _, w in rows), 0.0, 1
    last = None
    for key, w in rows:
        seen += w
        while k < pieces and seen >= total * k / pieces:
            head = key[:level + 1]
            out.add(_key([*head, 0, 0][:3]))
            if head == last and head[-1] < (1 << 64) - 1:
                out.add(_key([*head[:-1], head[-1] + 1, 0, 0][:3]))
            last, k = head, k + 1
    return out


def splitters(records: DataFrame, shards: int, parts: int = PARTS, oversample: int = OVERSAMPLE
              ) -> tuple[list[bytes], list[Range]]:
    """(boundaries, measured ranges): no range of several records is over twice total / (shards * parts)."""
    bounds: list[bytes] = []
    ranges = measure(records, bounds)
    target = max(sum(r.size for r in ranges) / (shards * parts), 1)
    turn = 0
    while over := {r.number: r for r in ranges if r.size > 2 * target and r.rows > 1}:
        turn += 1
        drawn = sample(records, bounds, {n: oversample / target for n in over}, turn)
        new = set(bounds)
        for n, rows in drawn.items():
            new |= quantiles(rows, math.ceil(over[n].size / target), over[n].level)
        if len(new) > len(bounds):  # else: draw again, with other chances
            bounds = sorted(new)
            ranges = measure(records, bounds)
    return bounds, ranges


def deal(ranges: list[Range], shards: int) -> dict[int, tuple[int, int]]:
    """Per range its shard and first slot.  The ranges of one content stay
    together unless it outweighs a whole shard; heaviest first, each to the lightest shard."""
    share = sum(r.size for r in ranges) / shards
    groups: dict = {}
    for r in ranges:
        groups.setdefault(("one", r.low[0]) if r.level else ("many", r.number), []).append(r)
    units = []
    for members in groups.values():
        units += [members] if sum(r.size for r in members) <= share else [[r] for r in members]
    units.sort(key=lambda u: (-sum(r.size for r in u), u[0].number))
    heap = [(0, s) for s in range(shards)]
    place, rows = {}, [0] * shards
    for unit in units:
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + sum(r.size for r in unit), s))
        place |= {r.number: s for r in unit}
    out = {}
    for r in ranges:
        s = place[r.number]
        out[r.number] = (s, rows[s])
        rows[s] += r.rows
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    carry: dict[str, Column] | None = None, parts: int = PARTS, oversample: int = OVERSAMPLE) -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` shards whose sizes (UTF-8 bytes
    of the text + 8 a row) are near equal: about 2 / ``parts`` of a shard apart,
    or one row, or one group of equal texts that is no larger than a shard.

    Returns id, size, shard (from 0), slot (gapless from 0 in its shard) and the
    ``carry`` columns (name: expression over ``docs``).  Null text is empty.
    Equal texts share a shard unless together they outweigh one; then they are
    cut by id, and rows of one id and text by row.  A single row is never cut.
    Null and repeated ids are rows like others; an empty table gives none; with
    fewer rows than shards some shards stay empty.  Which of equal rows stands
    where may differ between runs.
    """
    if shards < 1 or parts < 1 or oversample < 1:
        raise ValueError("shards, parts and oversample are at least 1")
    prepare(docs.sparkSession)
    carry = carry or {}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [F.col(id_col).alias("_shard_id"), *[c.alias(f"_shard_of_{name}") for name, c in carry.items()]]
    # written once: row numbers and hashes are the same in every pass
    records = written(docs.select(*keep, (F.octet_length(text) + EXTRA).cast("long").alias(SIZE),
                                  F.xxhash64(text).alias(KEYS[0]), F.xxhash64(F.col(id_col).cast("string")).alias(KEYS[1]),
                                  F.monotonically_increasing_id().alias(ROW_KEY)), "sharding")
    bounds, ranges = splitters(records, shards, parts, oversample)
    dealt = deal(ranges, shards)
    cuts = np.array(bounds, "S24")
    shard, first = np.zeros(len(bounds) + 1, np.int32), np.zeros(len(bounds) + 1, np.int64)
    for r, (s, f) in dealt.items():
        shard[r], first[r] = s, f
    order = [*KEYS, SIZE, *[c for c in records.columns if c not in (*KEYS, SIZE)]]
    records = records.select(*order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)

    def place(batches):
        for batch in batches:
            r = _ranges(_columns(batch)[0], cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(shard[r]), pa.array(first[r])],
                                             names=[*order, "_shard_range", "_shard", "_shard_first"])

    placed = records.mapInArrow(place, f"{types}, _shard_range long, _shard int, _shard_first long")
    turn = F.row_number().over(Window.partitionBy("_shard_range").orderBy(*KEYS))
    return placed.select(F.col("_shard_id").alias(id_col), F.col(SIZE).alias("size"), F.col("_shard").alias("shard"),
                         (F.col("_shard_first") + turn - 1).alias("slot"),
                         *[F.col(f"_shard_of_{name}").alias(name) for name in carry])


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet folders ``shard=0`` and so on below ``path``."""
    sharded.write.partitionBy("shard").parquet(path)
