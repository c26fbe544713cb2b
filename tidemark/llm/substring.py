"""Substring dedup by level-wise doubling.

Every window of ``window`` words that starts more than once in the corpus is
removed wherever it stands.  Windows of a short length are counted first; only
where a stretch of them is repeated throughout are windows of twice the length
counted, and so on up to ``window`` (9, 18, 35 for 35): a window can repeat
only where all the shorter windows in it do.

Documents are dealt to blocks by their id once; the same exchange feeds all
levels.  For a level each block sends the hashes of its candidate windows, as
sorted sets cut by hash range, to the range's task, and gets back those that
also occur elsewhere.  A passage that a third of all documents share is
one entry per block, however often it stands there.  Shorter levels carry only the
upper bits of a hash, as a collision there only leaves a candidate in; the
last level carries 64 bits of hashes that are not derived from the others'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (Words, mix, pack_sorted, partitions, prepare, slices, span_hashes, text_bytes,
                                 unpack_sorted)

FIRST = 9  # words of the shortest windows counted, at most
FILTER_BITS = 44  # of a hash at all levels but the last


def lengths(window: int, first: int = FIRST) -> list[int]:
    """Window lengths of the levels, ascending: each at most twice the one before."""
    found = [window]
    while found[0] > first:
        found.insert(0, -(-found[0] // 2))
    return found


class Block:
    """Word hashes of a block's documents, laid end to end."""

    def __init__(self, column):
        data, offsets = text_bytes(column)
        hashes, firsts, n = [], [], 0
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j)
            hashes.append(w.hash)
            firsts.append(w.first[:-1] + n)
            n += len(w)
        self.data, self.offsets = data, offsets
        self.word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.append(np.concatenate(firsts), n) if firsts else np.zeros(1, np.int64)
        self.end = np.repeat(self.first[1:], np.diff(self.first))  # of each word's document

    def windows(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(valid, hash) for the window of ``length`` words at each word."""
        n = len(self.word)
        valid = np.arange(n) + length <= self.end
        found = np.zeros(n, np.uint64)
        at = np.flatnonzero(valid)
        # another scrambling of the words for each length
        salted = mix(self.word + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))
        found[at] = span_hashes(salted, at, length) >> np.uint64(64 - bits)
        return valid, found

    def repeated(self, length: int, bits: int, elsewhere: np.ndarray) -> np.ndarray:
        """Whether the window at each word also starts somewhere else."""
        valid, found = self.windows(length, bits)
        once, more = counted(found[valid])
        known = np.union1d(more, elsewhere)
        if not len(known):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return valid & (known[at] == found)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that occur once, values that occur more often), both ascending."""
    v = np.sort(values)
    if not len(v):
        return v, v
    begins = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    n = np.diff(np.append(begins, len(v)))
    return v[begins[n == 1]], v[begins[n > 1]]


def stretches(flags: np.ndarray, length: int) -> np.ndarray:
    """Positions from which ``length`` flags in a row are set."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    out = np.zeros(len(flags), bool)
    if len(flags) >= length:
        out[:len(flags) - length + 1] = sums[length:] - sums[:-length] == length
    return out


def spread(flags: np.ndarray, length: int) -> np.ndarray:
    """Positions at most ``length`` - 1 behind a set flag (it included)."""
    sums = np.concatenate([np.zeros(length, np.int64), np.cumsum(flags)])
    return sums[length:] > sums[:-length]


def bucket_of(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    top = values >> np.uint64(bits - 32)
    return (top * np.uint64(buckets)) >> np.uint64(32)


_SETS = "_block int, _bucket int, once binary, more binary"
_BACK = "_block int, back binary"


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None, blocks: int | None = None, first: int = FIRST,
                   bits: int = FILTER_BITS, layout: bool = False) -> DataFrame:
    """(id, *carry, kept_text, n_words, n_removed) for every row of ``docs``.

    Words are runs of characters other than space and U+0009..U+000D.  A word
    goes if a window of ``window`` words that covers it also starts anywhere
    else in the input, the same document included (overlapping itself too).
    Kept words are joined by one space; with ``layout`` the removed words are cut
    out of the text as it stands, each with the white space up to the next
    word, so a text that loses nothing stays as it is.  Null and empty texts have no words and
    an empty kept text; so do texts that are removed whole: no row is dropped.
    Rows that repeat an id are documents of their own, null ids stay null, an
    empty table gives an empty result; other columns play no part, and those
    named in ``carry`` are passed on.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = blocks or partitions(spark)
    carry = carry or []
    levels = lengths(window, first)
    level_bits = [bits] * (len(levels) - 1) + [64]
    base = docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int").alias("_block"), F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])

    passed = [c for c in base.columns if c not in ("_block", "_text")]

    def sets_of(block: int, values: np.ndarray, nbits: int) -> pa.Table:
        once, more = counted(values)
        edges = np.arange(blocks + 1)
        cuts = [np.searchsorted(bucket_of(v, nbits, blocks), edges) for v in (once, more)]
        rows = [(block, b, pack_sorted(once[cuts[0][b]:cuts[0][b + 1]]), pack_sorted(more[cuts[1][b]:cuts[1][b + 1]]))
                for b in range(blocks) if cuts[0][b] < cuts[0][b + 1] or cuts[1][b] < cuts[1][b + 1]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table({"_block": pa.array(cols[0], pa.int32()), "_bucket": pa.array(cols[1], pa.int32()),
                         "once": pa.array(cols[2], pa.binary()), "more": pa.array(cols[3], pa.binary())})

    def elsewhere(back: pa.Table) -> np.ndarray:
        found = [unpack_sorted(x.as_py()) for x in back.column("back")]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def start(table: pa.Table) -> pa.Table:
        block = Block(table.column("_text"))
        valid, found = block.windows(levels[0], level_bits[0])
        number = table.column("_block")[0].as_py() if table.num_rows else 0
        return sets_of(number, found[valid], level_bits[0])

    def extend(k: int):
        before, now = levels[k - 1], levels[k]

        def run(table: pa.Table, back: pa.Table) -> pa.Table:
            if not table.num_rows:
                return sets_of(0, np.zeros(0, np.uint64), level_bits[k])
            block = Block(table.column("_text"))
            repeated = block.repeated(before, level_bits[k - 1], elsewhere(back))
            candidate = stretches(repeated, window - before + 1)  # starts of full windows
            valid, found = block.windows(now, level_bits[k])
            wanted = valid & spread(candidate, window - now + 1)
            return sets_of(table.column("_block")[0].as_py(), found[wanted], level_bits[k])

        return run

    def meet(table: pa.Table) -> pa.Table:
        """For each block, its values that occur once there and elsewhere too."""
        once = [unpack_sorted(x.as_py()) for x in table.column("once")]
        more = [unpack_sorted(x.as_py()) for x in table.column("more")]
        every = np.sort(np.concatenate([*once, *more, *more]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        if len(again):
            for block, values in zip(table.column("_block").to_pylist(), once, strict=True):
                at = np.minimum(np.searchsorted(again, values), len(again) - 1)
                hit = values[again[at] == values]
                if len(hit):
                    out.append((block, pack_sorted(hit)))
        cols = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table({"_block": pa.array(cols[0], pa.int32()), "back": pa.array(cols[1], pa.binary())})

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        n = table.num_rows
        block = Block(table.column("_text"))
        repeated = block.repeated(levels[-1], 64, elsewhere(back)) if n else np.zeros(0, bool)
        gone = spread(repeated, window)
        n_words = np.diff(block.first)
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_gone = sums[block.first[1:]] - sums[block.first[:-1]]
        text = pa.concat_arrays([pa.array([], pa.string()), *(cut_texts if layout else kept_texts)(block, ~gone)])
        kept = {c: table.column(c) for c in passed}
        return pa.table(kept | {"kept_text": text, "n_words": pa.array(n_words, pa.int64()),
                                "n_removed": pa.array(n_gone, pa.int64())})

    sets = base.groupBy("_block").applyInArrow(start, _SETS)
    for k in range(1, len(levels) + 1):
        back = sets.groupBy("_bucket").applyInArrow(meet, _BACK)
        both = base.groupBy("_block").cogroup(back.groupBy("_block"))
        if k < len(levels):
            sets = both.applyInArrow(extend(k), _SETS)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema.fields if f.name in passed)
    out = both.applyInArrow(finish, kinds + "kept_text string, n_words bigint, n_removed bigint")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                      "kept_text", "n_words", "n_removed")


def kept_texts(block: Block, keep: np.ndarray) -> list[pa.Array]:
    """The kept words of each document joined by one space, slice by slice."""
    out = []
    for i, j in slices(block.offsets):
        w = Words(block.data, block.offsets, i, j, hashes=False)
        picked = np.flatnonzero(keep[block.first[i]:block.first[i] + len(w)])
        row = np.searchsorted(w.first, picked, "right") - 1
        begin, end = w.start[picked], w.end[picked].copy()
        raw = np.append(w.data, np.uint8(0x20))
        joined = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
        raw[end[joined]] = 0x20  # the separator after a kept word that another follows
        end[joined] += 1
        marks = np.zeros(len(raw) + 1, np.int32)
        marks[begin] += 1
        np.add.at(marks, end, -1)
        inside = np.cumsum(marks[:-1]) > 0
        sizes = np.zeros(j - i, np.int64)
        np.add.at(sizes, row, end - begin)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        out.append(pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets.tobytes()),
                                               pa.py_buffer(raw[inside].tobytes())))
    return out


def cut_texts(block: Block, keep: np.ndarray) -> list[pa.Array]:
    """Each document without the words that are not kept and the white space after them, slice by slice."""
    out = []
    for i, j in slices(block.offsets):
        w = Words(block.data, block.offsets, i, j, hashes=False)
        gone = np.flatnonzero(~keep[block.first[i]:block.first[i] + len(w)])
        row = np.searchsorted(w.first, gone, "right") - 1
        last = gone + 1 == w.first[row + 1]  # the document's last word goes alone
        begin = w.start[gone]
        end = np.where(last, w.end[gone], np.append(w.start, 0)[gone + 1])
        marks = np.zeros(len(w.data) + 1, np.int32)
        np.add.at(marks, begin, 1)
        np.add.at(marks, end, -1)
        inside = np.cumsum(marks[:-1]) == 0
        sizes = np.diff(block.offsets[i:j + 1])
        np.subtract.at(sizes, row, end - begin)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        out.append(pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets.tobytes()),
                                               pa.py_buffer(w.data[inside].tobytes())))
    return out
