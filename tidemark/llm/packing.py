"""Best-fit packing by linear grouping.

Pieces have at most ``size`` tokens, so all that the plan depends on is the
number of pieces of each length: a histogram of at most ``size`` entries,
whatever the corpus.  The plan is made from it on the driver:

1. Large lengths are split, from the longest on, into groups of equal
   cardinality and rounded up to the longest of their group.
2. The few rounded sizes are packed by configurations: a linear programme over
   them, its columns generated by a knapsack on the dual prices, rounded down.
3. Actual lengths take the places of the rounded sizes, in a configuration's
   last place the longest that fits beside the others; so the room that
   rounding left is used, and what remains is known for every sequence.
4. Large pieces left over, then the small ones, longest first, go where they
   leave the least room; new sequences open only when nothing fits.

Sequences with the same contents are one run (first sequence, count), so the
plan is a short list of (length, first rank, count, first sequence, offset).
Pieces are numbered within their length by Spark and look their place up.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import WordCoder, split_specials
from tidemark.llm.common import partitions, prepare, slices, text_bytes, written
from tidemark.llm.pretoken import distinct_words

GROUPS = 96  # rounded sizes of the linear grouping
SMALL = 0.45  # lengths up to this share of a sequence are small
SHARE = 0.8  # of each configuration; best fit places what the rest would hold


# --- the plan, from the histogram of lengths --------------------------------

def knapsack(sizes: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of ``sizes`` that fits (value, counts)."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        fits = sizes <= room
        if fits.any():
            value = np.where(fits, best[np.maximum(room - sizes, 0)] + prices, -1.0)
            j = int(value.argmax())
            if value[j] > best[room] + 1e-12:
                best[room], took[room] = value[j], j
    counts, room = np.zeros(len(sizes), np.int64), size
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[size]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int, most: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(counts per size, number of sequences): the linear programme rounded down."""
    k = len(sizes)
    basis = np.diag((size // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(most):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = knapsack(sizes, prices, size)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.linalg.solve(basis, demand.astype(float))
        x = np.maximum(x, 0)
    return [(basis[:, p].round().astype(np.int64), int(np.floor(SHARE * x[p] + 1e-6))) for p in range(k)
            if int(np.floor(SHARE * x[p] + 1e-6)) > 0]


class Plan:
    """Runs of sequences with equal contents, and the places given so far."""

    def __init__(self, size: int):
        self.size, self.sequences = size, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.places: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.empty: list[tuple[int, int]] = []

    def open(self, count: int) -> tuple[int, int]:
        first = self.sequences
        self.sequences += count
        return first, count

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.places.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count

    def best_fit(self, length: int, count: int) -> None:
        """``count`` pieces of one length, each where it leaves the least room."""
        while count:
            fit = next((r for r in range(length, self.size + 1) if self.room.get(r)), None)
            if fit is None:
                per = self.size // length
                if self.empty:  # opened by a configuration that found no pieces
                    first, opened = self.empty.pop()
                    spare = opened - -(-count // per)
                    if spare > 0:
                        opened -= spare
                        self.empty.append((first + opened, spare))
                else:
                    first, opened = self.open(-(-count // per))
                for i in range(per):
                    took = min(count, opened)
                    if took < opened:
                        self.room[self.size - i * length].append((first + took, opened - took))
                        opened = took
                    if not took:
                        break
                    self.put(length, took, first, i * length)
                    count -= took
                if opened:
                    self.room[self.size - per * length].append((first, opened))
                continue
            first, have = self.room[fit].pop()
            took = min(count, have)
            if took < have:
                self.room[fit].append((first + took, have - took))
            self.put(length, took, first, self.size - fit)
            self.room[fit - length].append((first, took))
            count -= took


def plan_packing(histogram: dict[int, int], size: int, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """The places of all pieces, from {length: count}; lengths from 1 to ``size``."""
    plan = Plan(size)
    left = {n: int(c) for n, c in histogram.items() if c}
    if left.get(size):
        first, count = plan.open(left.pop(size))
        plan.put(size, count, first, 0)
    large = sorted((n for n in left if n > small * size), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # the rounded size of a group is its longest length; equal ones are one size
        each, upto, need = -(-total // groups), 0, {}
        ranks = np.cumsum([left[n] for n in large])
        while upto < total:
            top = large[int(np.searchsorted(ranks, upto, "right"))]
            took = min(each, total - upto)
            need[top] = need.get(top, 0) + took
            upto += took
        sizes, demand = np.array(list(need)), np.array(list(need.values()))
        def longest(most: int) -> int:
            """The longest large length left, at most ``most`` (0: none)."""
            return next((n for n in range(min(most, large[0]), large[-1] - 1, -1) if left.get(n)), 0)

        for counts, sequences in configurations(sizes, demand, size):
            places = [int(sizes[g]) for g in np.flatnonzero(counts) for _ in range(int(counts[g]))]
            first, todo = plan.open(sequences)
            runs = [(first, todo, 0)]
            for k, rounded in enumerate(places):
                after = []
                for start, many, used in runs:
                    while many:
                        # its own size; the last place takes what the others left free
                        n = longest(size - used if k == len(places) - 1 else rounded)
                        if not n:
                            after.append((start, many, used))
                            break
                        took = min(left[n], many)
                        plan.put(n, took, start, used)
                        left[n] -= took
                        after.append((start, took, used + n))
                        start, many = start + took, many - took
                runs = after
            for start, many, used in runs:
                if used:
                    plan.room[size - used].append((start, many))
                else:
                    plan.empty.append((start, many))
    for n in sorted(left, reverse=True):
        plan.best_fit(n, left[n])
    return plan


# --- tokens and pieces --------------------------------------------------------

@lru_cache(maxsize=1)
def id_coder(path: str) -> tuple[WordCoder, dict[str, int]]:
    """Words to the little-endian 32-bit ids that the tokenizers library gives
    them; kept by each worker, so words that one task coded are known to its next."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def code(words: list[bytes]) -> list[bytes]:
        pack = struct.pack
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        found = (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [pack(f"<{len(i)}I", *i) for i in found]

    return WordCoder(code), specials


def id_bytes(texts: list[str], coder: WordCoder, specials: dict[str, int]) -> list[bytes]:
    pieces, owner, fixed = [], [], {}
    for row, text in enumerate(texts):
        parts = split_specials(text, specials) if any(s in text for s in specials) else [text]
        for part in parts:
            if isinstance(part, int):
                fixed[len(pieces)] = np.array([part], "<u4").tobytes()
                part = ""
            pieces.append(part)
            owner.append(row)
    words, which, row = distinct_words(pieces, "byte")
    codes = coder.look_up(words)
    # every word's ids laid out one after the other, without an object per word
    size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    first = np.cumsum(size) - size
    length = size[which]
    ends = np.cumsum(length)
    every = np.frombuffer(b"".join(codes), "<u4")
    ids = every[np.arange(int(length.sum())) + np.repeat(first[which] - (ends - length), length)]
    edges = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(pieces) + 1))].tolist()
    out: list[list[bytes]] = [[] for _ in texts]
    for k, r in enumerate(owner):
        out[r].append(fixed.get(k) or ids[edges[k]:edges[k + 1]].tobytes())
    return [b"".join(p) for p in out]


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else a shorter
    first piece where the length asks for it, then full ones."""
    first = n % size or size
    return [(0, min(n, first)), *[(s, size) for s in range(first, n, size)]]


def document_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        coder, specials = id_coder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in slices(offsets):
                texts = [bytes(data[offsets[k]:offsets[k + 1]]).decode("utf-8", "replace") for k in range(i, j)]
                at, rows = [], []
                for k, blob in enumerate(id_bytes(texts, coder, specials)):
                    blob += tail
                    for p, (s, n) in enumerate(cut_points(len(blob) // 4, size)):
                        at.append(i + k)
                        rows.append((p, s, n, zlib.crc32(blob[4 * s:4 * (s + n)])))
                p, s, n, c = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(p, pa.int32()), pa.array(s, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def number_within(pieces: DataFrame, id_col: str) -> DataFrame:
    """``rank`` from 0 within each length.  A length that many pieces share is
    numbered in slices (by a hash of id and piece), each slice after the ones
    before it."""
    slots = 4 * partitions(pieces.sparkSession)
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(slots)))
    counts = cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("length").alias("_l"), F.col("_slice").alias("_s"),
                           F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(id_col, "piece", "ids_crc32"))
    numbered = cut.withColumn("_inner", inner)
    return numbered.join(starts, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s"))).withColumn(
        "rank", F.col("_before") + F.col("_inner") - 1).drop("_slice", "_inner", "_l", "_s", "_before")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Null and empty texts are a document of the end token alone.  Rows that
    repeat an id are documents of their own (equal ones may swap places), null
    ids stay null, an empty table gives an empty result; other columns play no
    part.  Pieces are written once to the shared folder, numbered from there.
    """
    prepare(docs.sparkSession)
    pieces = written(document_pieces(docs, path, size, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(histogram, size, groups)
    table = np.array(plan.places, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # one key per place: places of a length follow each other without gaps
    stride = int(table[:, 1].max() + table[:, 2].max() + 1) if len(table) else 1
    keys = table[:, 0] * stride + table[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * stride + rank, "right") - 1
            seq = table[k, 3] + rank - table[k, 1]
            kept = [batch.column(n) for n in batch.schema.names if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int64()), pa.array(table[k, 4], pa.int64())],
                                             names=[*names, "sequence_id", "offset"])

    numbered = number_within(pieces, id_col)
    kind = pieces.schema[0].dataType.simpleString()
    return numbered.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                      "sequence_id bigint, offset bigint")
