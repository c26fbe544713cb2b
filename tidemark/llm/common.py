"""Shared helpers: session settings, shared folders, and texts as numpy arrays.

Texts reach numpy as the byte buffer of an Arrow column; words, their hashes
and the hashes of windows of words are computed for a whole slice at once.
Slices are bounded by bytes, so a task's memory does not depend on how many
or how long its documents are (one single document is the smallest unit).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, ship_package

# Text bytes of one numpy slice (a longer document is one slice by itself).
SLICE_BYTES = 1 << 21
# Rows of one Arrow batch: 1024 documents of a few KB are a few MB.
BATCH_ROWS = 1024

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def prepare(spark: SparkSession) -> None:
    """Package on the workers, UTC, and Arrow batches small enough for texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read
    back: cuts the lineage, and the copy outlives any executor."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"tidemark-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow text columns as byte buffers ------------------------------------

def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (single longer rows alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# --- words and their hashes --------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (a finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, int]] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64 (kept by worker, at most a slice long)."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        kept = np.multiply.accumulate(p)
        if n <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = kept
    return kept[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, length: np.ndarray | int,
                base: np.uint64 = _BASE, inverse: np.uint64 = _INVERSE) -> np.ndarray:
    """64-bit hash of values[start : start + length] for each start.

    Polynomial prefix sums modulo 2 ** 64 with an odd base; dividing by
    base ** start makes equal sequences equal wherever they stand.
    """
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    h = (sums[start + length] - sums[start]) * powers(inverse, len(values) + 1)[start]
    return mix(h + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of the rows i .. j of a text column.

    start, end: byte positions in ``data``; first: index of each row's first
    word (j - i + 1 entries); hash: 64 bits per word (when asked for).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int,
                 separators: np.ndarray = SPACE, lower: bool = False, hashes: bool = True):
        self.base = int(offsets[i])
        raw = data[self.base:int(offsets[j])]
        if lower:
            raw = lower_ascii(raw)
        self.data = raw
        rel = offsets[i:j + 1] - self.base
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = ~separators[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        row_starts = rel[:-1][rel[:-1] < len(raw)]
        begins[row_starts] = inside[row_starts]  # a word never spans two rows
        self.start = np.flatnonzero(begins)
        ends = np.zeros(len(raw) + 1, bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        cut = row_starts[row_starts > 0]
        ends[cut] |= inside[cut - 1]
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, rel)
        self.hash = span_hashes(_BYTES[raw], self.start, self.end - self.start) if hashes else None

    def __len__(self) -> int:
        return len(self.start)

    def rows(self) -> np.ndarray:
        """Row (from 0) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_BYTES = _table(7)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 0x41) & (raw <= 0x5A)
    return np.where(upper, raw + np.uint8(0x20), raw)


def words_of(column, separators: np.ndarray = SPACE, lower: bool = False,
             hashes: bool = True) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        yield i, j, Words(data, offsets, i, j, separators, lower, hashes)


# --- sets of integers as compressed blobs ------------------------------------

_SQUEEZE, _UNSQUEEZE = None, None


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers: byte planes of their differences, zstd."""
    global _SQUEEZE
    _SQUEEZE = _SQUEEZE or zstandard.ZstdCompressor(level=1)
    v = np.asarray(values, "<u8")
    d = v.copy()
    d[1:] -= v[:-1]
    return _SQUEEZE.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    global _UNSQUEEZE
    _UNSQUEEZE = _UNSQUEEZE or zstandard.ZstdDecompressor()
    planes = np.frombuffer(_UNSQUEEZE.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Any integers of one type: their byte planes, zstd."""
    global _SQUEEZE
    _SQUEEZE = _SQUEEZE or zstandard.ZstdCompressor(level=1)
    v = np.ascontiguousarray(values)
    return _SQUEEZE.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    global _UNSQUEEZE
    _UNSQUEEZE = _UNSQUEEZE or zstandard.ZstdDecompressor()
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_UNSQUEEZE.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def crc_remainder(column: str, modulus: int = 5):
    """crc32 of an integer column's decimal text, modulo ``modulus`` (folds)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
