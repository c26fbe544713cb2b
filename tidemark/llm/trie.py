"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns.  Nodes are made by one grouped
count of (conversation, depth) rows.  Subtree totals then go upwards: inside a
shard the nodes are sorted by falling depth (Spark's external sort) and
streamed; every node sends its totals to its parent through a priority queue
that spills, and takes its children's from it.  A shard holds whole light
subtrees.  The nodes above them, too heavy for a shard, get the totals of the
shard roots, added up by parent, and are streamed the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, prepare, written

CHUNK = 4096  # turns of one conversation that one window covers
QUEUE_ROWS = 200_000  # messages that a queue holds in memory
LIST_CHARS = 1 << 16  # characters of member ids in one row
WORD = r"[^\x20\x09-\x0D]+"
SHARE = 4  # a light subtree has at most 1 / (SHARE * shards) of all rows
NODE = ["depth", "p", "q"]


# --- rebuilt conversations as rows --------------------------------------------

@dataclass
class Turns:
    """Written rows: turns (conv, run, k: number within the run, key, words) and
    conversations' runs (conv, run, before: turns in earlier runs)."""
    rows: DataFrame
    runs: DataFrame


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> Turns:
    """Turns numbered in order.  A range exchange cuts very long conversations into
    runs, each numbered by itself; the runs' lengths give the rest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    rows = rows.repartitionByRange(partitions(turns.sparkSession), F.asc("conv"), *order)
    rows = rows.withColumn("run", F.spark_partition_id())
    # role and text cannot be confused: the role's length comes first
    key = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = rows.select("conv", "turn", "role", "text", "run", key.alias("key"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = written(rows, "trie-runs")
    k = F.row_number().over(Window.partitionBy("conv", "run").orderBy(*order)) - 1
    rows = written(rows.select("conv", "run", k.cast("long").alias("k"), "key", "words"), "trie-turns")
    runs = rows.groupBy("conv", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    runs = runs.select("conv", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                       F.sum("n").over(whole).alias("turns"))
    return Turns(rows, written(runs, "trie-lengths"))


def rebuilt(turns: Turns, family: int = 20, most: int = 4) -> DataFrame:
    """(conv, depth, len, key, words) of every rebuilt conversation; depth 0 with
    null key stands for the conversation itself."""
    base = F.col("conv") - F.col("conv") % family
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.runs.where("before = 0").select("conv", "turns", base.alias("base"), heads.alias("h"))
    givers = convs.where("conv = base").select(F.col("conv").alias("base"), F.col("turns").alias("given"))
    convs = convs.join(givers, "base", "left").select(
        "conv", "base", "h", "turns", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"))
    length = F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    convs = written(convs.withColumn("len", length.cast("long")), "trie-conversations")
    numbered = turns.rows.join(turns.runs.select("conv", "run", "before"), ["conv", "run"]).select(
        "conv", (F.col("before") + F.col("k")).alias("i"), "key", "words")
    own = numbered.join(convs.select("conv", "h", "taken", "len"), "conv").where("i >= h").select(
        "conv", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "len", "key", "words")
    first = numbered.where((F.col("i") < most - 1) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    lent = first.join(convs.select("conv", "base", "h", "len"), "base").where("i < h").select(
        "conv", (F.col("i") + 1).alias("depth"), "len", "key", "words")
    none = convs.select("conv", F.lit(0).cast("long").alias("depth"), "len", F.lit(None).cast("string").alias("key"),
                        F.lit(0).cast("long").alias("words"))
    return own.unionByName(lent).unionByName(none)


def prefixes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds the id of each first-d-turns sequence: p and q, exclusive ors of 64-bit
    hashes of (position, turn), and up_p, up_q, the same of one turn less."""
    x = F.when(F.col("key").isNull(), F.lit(0).cast("long"))
    rows = rows.select("conv", "depth", "len", "words", x.otherwise(F.xxhash64("depth", "key")).alias("x"),
                       x.otherwise(F.xxhash64("key", "depth", F.lit(1))).alias("y"),
                       F.floor(F.col("depth") / chunk).alias("part"))
    inside = Window.partitionBy("conv", "part").orderBy("depth")
    rows = written(rows.select("conv", "depth", "len", "words", "x", "y", "part", F.bit_xor("x").over(inside).alias("p"),
                               F.bit_xor("y").over(inside).alias("q")), "trie-chunks")
    # what the chunks before add; only conversations of several chunks have such rows
    ends = rows.where((F.col("depth") % chunk == chunk - 1) & (F.col("depth") < F.col("len")))
    upto = Window.partitionBy("conv").orderBy("part")
    carry = ends.select("conv", (F.col("part") + 1).alias("part"), F.bit_xor("p").over(upto).alias("cp"),
                        F.bit_xor("q").over(upto).alias("cq"))
    full = rows.join(carry, ["conv", "part"], "left")
    p, q = (F.col(a).bitwiseXOR(F.coalesce(F.col(c), F.lit(0))) for a, c in (("p", "cp"), ("q", "cq")))
    full = full.select("conv", "depth", "len", "words", "x", "y", p.alias("p"), q.alias("q"))
    return full.select("conv", "depth", "len", "words", "p", "q", F.col("p").bitwiseXOR(F.col("x")).alias("up_p"),
                       F.col("q").bitwiseXOR(F.col("y")).alias("up_q"))


# --- members that end at a node -------------------------------------------------

def ends_digests(rows: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ascending ids of the conversations that end there.

    Ids are sorted by (node, id) over all tasks, joined to rows of up to
    LIST_CHARS characters, and hashed as a stream of those, so a node where a
    third of all conversations end is a few rows and never one list."""
    n = partitions(rows.sparkSession)
    last = rows.where("depth = len").select(*NODE, "conv").repartitionByRange(n, *NODE, "conv")
    last = last.sortWithinPartitions(*NODE, "conv")

    def lists(batches):
        node, ids, chars = None, [], 0
        out: list[tuple] = []

        def close():
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for d, p, q, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, p, q) != node or chars > LIST_CHARS:
                    close()
                    node, ids, chars = (d, p, q), [], 0
                ids.append(conv)
                chars += 20
            if out:
                yield _batch(out, ["depth", "p", "q", "first", "ids"])
                out.clear()
        close()
        if out:
            yield _batch(out, ["depth", "p", "q", "first", "ids"])

    joined = last.mapInArrow(lists, "depth long, p long, q long, first long, ids string")

    def digests(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for d, p, q, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, p, q) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (d, p, q), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield _batch(out, [*NODE, "ends"])
        if node:
            yield _batch([(*node, digest.hexdigest())], [*NODE, "ends"])

    return joined.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        digests, "depth long, p long, q long, ends string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    texts = {"ids", "ends"}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if n in texts else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)


# --- time-forward processing ------------------------------------------------------

class SpillingQueue:
    """A priority queue of tuples; beyond ``most`` the smallest-first sorted
    messages go to a file of the task that is gone with it (like Spark's own spills)."""

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.heap, self.runs, self.spilled = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            run = self._read(self._write(self.heap))
            self.heap = []
            self.spilled += 1
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _write(items: list):
        f = tempfile.TemporaryFile()
        for k in range(0, len(items), 4096):
            pickle.dump(items[k:k + 4096], f, protocol=5)
        f.seek(0)
        return f

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        with f:
            while True:
                try:
                    items = pickle.load(f)
                except EOFError:
                    return
                yield from items

    def peek(self) -> tuple | None:
        best = self.heap[0] if self.heap else None
        if self.runs and (best is None or self.runs[0][0] < best):
            best = self.runs[0][0]
        return best

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return item
        return heapq.heappop(self.heap)


FIELDS = [*NODE, "up_p", "up_q", "root", "conv_id", "n_convs", "words", "in_children", "in_leaves", "in_saved", "ends"]
DONE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
ROOTS = [*DONE, "up_p", "up_q", "pending"]
ROOTS_TYPE = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
              "saved_tokens long, ends string, up_p long, up_q long, pending boolean")


def time_forward(batches: Iterator[pa.RecordBatch], most: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Finished nodes from FIELDS rows sorted by falling depth, then p and q.

    A node's message carries its own finished row, so its parent, which comes
    later, completes it with the parent's conversation.  Roots of the stream
    (``root``) leave with ``pending`` set where a parent waits elsewhere.
    ``in_*`` are totals that came from children elsewhere."""
    queue = SpillingQueue(most)
    for batch in batches:
        out: list[tuple] = []
        for d, p, q, up_p, up_q, root, conv, convs, words, children, leaves, saved, ends in zip(
                *(c.to_pylist() for c in batch.columns)):
            here = (-d, p, q)
            while (message := queue.peek()) is not None and message[:3] <= here:
                (*to, child, child_conv, child_convs, child_children, child_leaves, child_saved, child_ends) = queue.pop()
                if tuple(to) != here:
                    raise ValueError("a node without its parent")
                children += 1
                leaves += child_leaves
                saved += child_saved
                out.append((child, child_conv, conv, child_convs, child_children, child_leaves, child_saved, child_ends,
                            0, 0, False))
            leaves += children == 0
            saved += (convs - 1) * words
            if root:
                out.append((d, conv, None, convs, children, leaves, saved, ends, up_p, up_q, d > 0))
            else:
                queue.push((1 - d, up_p, up_q, d, conv, convs, children, leaves, saved, ends))
        if out:
            yield _finished(out)
    if queue.peek() is not None:
        raise ValueError("a node without its parent")


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"ends": pa.string(), "pending": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(ROOTS, zip(*rows))], names=ROOTS)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", family: int = 20, shards: int | None = None, chunk: int = CHUNK,
                queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns are ordered by turn (null first), ties by role and text; null role or
    text is empty; rows without a conversation id count for nothing; other
    columns are ignored.  Conversation c becomes the first h turns of
    c - c % ``family`` (all if fewer; % has the sign of c), then its own turns
    after its first h; h = crc32(decimal c) % 4.  A node is a distinct sequence
    of first d rebuilt turns, the root (d = 0) included; sequences are told
    apart by 128 bits.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  An empty table has no node.

    The heavy nodes, each over 1 / (4 * shards) of all rows, are streamed
    through one task in bounded memory: at most 4 * shards for each depth.
    """
    spark = turns.sparkSession
    prepare(spark)
    shards = shards or partitions(spark)
    rows = written(prefixes(rebuilt(ordered_turns(turns, conv_col, turn_col, role_col, text_col), family), chunk),
                   "trie-prefixes")
    # every member adds its turns from here on: an upper bound of the subtree's nodes
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("up_p").alias("up_p"), F.min("up_q").alias("up_q"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    digests = ends_digests(rows).withColumnRenamed("ends", "_ends")
    none = hashlib.sha256(b"").hexdigest()
    nodes = written(nodes.join(digests, NODE, "left").withColumn("ends", F.coalesce("_ends", F.lit(none))).drop("_ends"),
                    "trie-nodes")
    light = max(rows.count() // (SHARE * shards), 1)
    heavy = nodes.where(F.col("weight") > light)

    # each conversation's highest light prefix is the root of its light subtree
    marked = rows.select("conv", *NODE).join(heavy.select(*NODE, F.lit(True).alias("heavy")), NODE, "left")
    top = marked.where(F.col("heavy").isNull()).groupBy(F.col("conv").alias("conv_id")).agg(
        F.min(F.struct("depth", "p", "q")).alias("top"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("in_children", "in_leaves", "in_saved")]
    below = nodes.where(F.col("weight") <= light).join(top, "conv_id").select(
        *NODE, "up_p", "up_q", (F.col("depth") == F.col("top.depth")).alias("root"), "conv_id", "n_convs", "words", *zero,
        "ends", F.xxhash64("top.p", "top.q").alias("unit"))

    def run(batches):
        return time_forward(batches, queue_rows)

    falling = [F.desc("depth"), F.asc("p"), F.asc("q")]
    shard = below.repartition(shards, "unit").sortWithinPartitions(*falling).select(*FIELDS)
    lower = written(shard.mapInArrow(run, ROOTS_TYPE), "trie-lower")

    # shard roots' totals, added up by parent, reach the heavy nodes
    roots = lower.where("pending")
    sums = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(
        F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
    above = heavy.join(sums, NODE, "left").na.fill(0, ["in_children", "in_leaves", "in_saved"]).select(
        *NODE, "up_p", "up_q", (F.col("depth") == 0).alias("root"), "conv_id", "n_convs", "words",
        "in_children", "in_leaves", "in_saved", "ends", F.lit(0).alias("unit"))
    above = above.repartition(shards, "unit").sortWithinPartitions(*falling).select(*FIELDS)
    upper = above.mapInArrow(run, ROOTS_TYPE)

    parents = heavy.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"),
                           F.col("conv_id").alias("above"))
    joined = roots.drop("parent_conv_id").join(parents, ["depth", "up_p", "up_q"]).withColumnRenamed("above", "parent_conv_id")
    whole = lower.where("NOT pending").select(*DONE).unionByName(joined.select(*DONE)).unionByName(upper.select(*DONE))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.col("ends").alias("ends_sha256"))
