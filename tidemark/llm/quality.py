"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one per hashed word and one per
hashed character 3- to 5-gram inside a word (its boundaries count as
characters), followed by a softmax over the two classes.  Vectors and output
are trained by numpy stochastic gradient descent on a bounded sample of the
labelled rows; every document is then scored where it lies.  As the output
is linear in the average, scoring needs one number per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, Words, crc_remainder, mix, pack, prepare, slices, text_bytes, unpack

GRAM_BITS, WORD_BITS = 17, 16  # buckets of character n-grams and of words
BUCKETS = (1 << GRAM_BITS) + (1 << WORD_BITS)
GRAMS = (3, 4, 5)
STEPS = 2000  # mini-batches of training
MAX_TRAIN = 4000  # labelled rows learned from, at most (those with the least hash of their id)

_CODES = (mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)
_CODES[SPACE] = _CODES[32]


def feature_groups(data: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """(document from 0, bucket) arrays for the rows i .. j, one pair per kind of feature."""
    n = j - i
    base = int(offsets[i])
    sizes = np.diff(offsets[i:j + 1])
    raw = data[base:int(offsets[j])]
    # one space before, between and after the documents
    row = np.repeat(np.arange(n), sizes)
    text = np.full(len(raw) + n + 1, 32, np.uint8)
    text[np.arange(len(raw)) + row + 1] = raw
    starts = offsets[i:j] - base + np.arange(n)  # each document's leading space
    space = SPACE[text]
    spaces = np.concatenate([[0], np.cumsum(space)])
    code = _CODES[text]
    total = code.copy()
    for k in range(1, max(GRAMS)):
        factor = np.uint32(pow(0x01000193, k, 1 << 32))
        total = total[:len(code) - k] + code[k:] * factor
        size = k + 1
        if size in GRAMS and len(total):
            at = np.arange(len(total))
            at = at[spaces[at + size - 1] == spaces[at + 1]]  # no white space inside
            h = total[at] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B % (1 << 32))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            yield np.searchsorted(starts, at, "right") - 1, (h >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    words = Words(data, offsets, i, j)
    yield words.rows(), ((words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int32) + (1 << GRAM_BITS))


@dataclass
class Model:
    weight: np.ndarray  # per bucket: its vector times (output 1 - output 0)
    bias: float

    def score(self, column) -> np.ndarray:
        data, offsets = text_bytes(column)
        out = np.zeros(len(offsets) - 1)
        for i, j in slices(offsets):
            total, count = np.zeros(j - i), np.zeros(j - i)
            for row, bucket in feature_groups(data, offsets, i, j):
                total += np.bincount(row, self.weight[bucket], j - i)
                count += np.bincount(row, minlength=j - i)
            out[i:j] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, steps: int = STEPS, batch: int = 16,
          rate: float = 4.0, seed: int = 7) -> Model:
    """``steps`` mini-batches of gradient descent over (label, buckets, weights that sum to 1); zeros without rows."""
    if not rows:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    output, bias = ((rng.random((2, dim)) - 0.5) / dim).astype(np.float32), np.zeros(2, np.float32)
    done = 0
    while done < steps:
        order = rng.permutation(len(rows))
        for b in range(0, min(len(order), batch * (steps - done)), batch):
            picked = [rows[k] for k in order[b:b + batch]]
            label = np.array([r[0] for r in picked])
            size = [len(r[1]) for r in picked]
            bucket = np.concatenate([r[1] for r in picked])
            weight = np.concatenate([r[2] for r in picked]).astype(np.float32)
            row = np.repeat(np.arange(len(picked)), size)
            part = vectors[bucket] * weight[:, None]
            hidden = np.stack([np.bincount(row, part[:, d], len(picked)) for d in range(dim)], 1).astype(np.float32)
            logit = hidden @ output.T + bias
            logit -= logit.max(1, keepdims=True)
            prob = np.exp(logit)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(picked)), label] -= 1
            step = rate * (1 - done / steps)
            back = prob @ output
            output -= step / len(picked) * (prob.T @ hidden)
            bias -= 0.1 * step / len(picked) * prob.sum(0)
            np.add.at(vectors, bucket, -step * weight[:, None] * back[row])
            done += 1
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def sample_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    max_train: int, fold: int, folds: int):
    """(label, buckets, weights) of one row of each sampled labelled id, by id: of an
    id's texts that are not empty the one with the least hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(
        crc_remainder(id_col, folds) != fold)
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    text = F.when(F.length("_text") > 0, F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text")))
    rows = rows.groupBy("_id", "_label").agg(F.min(text).alias("_least")).select(
        "_id", F.col("_least.text").alias("_text"), "_label")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            blobs = []
            for i in range(len(offsets) - 1):
                parts = [b for _, b in feature_groups(data, offsets, i, i + 1)]
                bucket, count = np.unique(np.concatenate(parts), return_counts=True)
                blobs.append((pack(bucket.astype("<i4")), pack(count.astype("<i4"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b[0] for b in blobs], pa.binary()),
                 pa.array([b[1] for b in blobs], pa.binary())], names=["_id", "_label", "bucket", "count"])

    kind = rows.schema[0].dataType.simpleString()
    found = rows.select("_id", "_text", "_label").mapInArrow(
        run, f"_id {kind}, _label int, bucket binary, count binary").collect()
    out = []
    for r in sorted(found, key=lambda r: (r["_id"], bytes(r["bucket"]))):
        bucket, count = unpack(bytes(r["bucket"]), "<i4"), unpack(bytes(r["count"]), "<i4").astype(float)
        if len(bucket):
            out.append((r["_label"], bucket, count / count.sum()))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_train: int = MAX_TRAIN, fold: int = 0, folds: int = 5) -> Model:
    """A model from at most ``max_train`` labelled rows whose crc32(id) modulo
    ``folds`` is not ``fold``, one row per id.  Several labels of one id count by their mean,
    null labels and labels without a document do not count; without any label
    the model gives every text 0.5."""
    prepare(docs.sparkSession)
    return train(sample_features(docs, labels, id_col, text_col, label_col, max_train, fold, folds))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every text: 0 to 1, higher where label 1 is
    likelier.  Null counts as empty; an empty text gets the score of its class
    bias alone.  All rows and other columns stay; a column that has the score's
    name is replaced."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(model.score(pa.Array.from_pandas(text, type=pa.string())))

    return docs.withColumn(score_col, score(F.col(text_col)))
