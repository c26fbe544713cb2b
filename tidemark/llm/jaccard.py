"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Documents with the same set of shingles form one class, so copies cost
nothing beyond the first.  Each class has a MinHash signature, cut into the
labels of ``TREES`` tries of ``DEPTH`` values.  A trie is the sorted table of
its labels, in which equal prefixes lie together.  Matched prefixes are
shortened from the full depth until the expected share of partners at the
threshold that some trie has met reaches the target recall; what shares a
prefix of that length is compared by a bit sketch and by size.  What passes is
a candidate; candidates are connected to groups by stars, never listed as
pairs, and every group is verified on its members' whole shingle sets, by
counts of common shingles.

A prefix or a group that very many classes share is dealt out to pairs of its
slices, so that no task holds it whole and every two of its classes still meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, mix, partitions, prepare, slices, span_hashes, text_bytes, written
from tidemark.llm.components import components

TREES, DEPTH = 16, 8
RECALL = 0.9999  # expected share of partners at the threshold that the tries find
SLICE = 2048  # classes of one prefix compared in one place
SKETCH_LOSS = 1e-9  # the sketch drops a partner at the threshold with at most this chance

_K = TREES * DEPTH
_FACTORS = mix(np.arange(1, _K + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1001, 1001 + _K, dtype=np.uint64))


def depth_for(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which the expected recall is reached."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def sketch_agreement(threshold: float, bits: int = _K, loss: float = SKETCH_LOSS) -> int:
    """Bits that two sketches agree in at least, if their sets reach the threshold,
    by the binomial tail."""
    p, agree, below = (1 + threshold) / 2, 0, 0.0
    while agree < bits:
        below += math.comb(bits, agree) * p ** agree * (1 - p) ** (bits - agree)
        if below > loss:
            break
        agree += 1
    return agree


def shingle_sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, size: int):
    """(first, hash): each row's distinct shingle hashes, ascending, laid end to end.

    A shingle is ``size`` words in a row; a text with fewer words (and any) has
    one, all its words."""
    w = Words(data, offsets, i, j)
    n_words = np.diff(w.first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(j - i), count)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - first[row] + w.first[row]
    h = span_hashes(w.hash, at, np.minimum(n_words, size)[row])
    order = np.lexsort((h, row))
    h = h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    h, row = h[new], row[new]
    return np.searchsorted(row, np.arange(j - i + 1)), h


def set_keys(first: np.ndarray, h: np.ndarray) -> list[bytes]:
    """128 bits of each row's set (sums of two scramblings of its members), and its size."""
    sums = []
    for seed in (11, 29):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(seed << 40)), dtype=np.uint64)])
        sums.append(total[first[1:]] - total[first[:-1]])
    table = np.stack([*sums, np.diff(first).astype(np.uint64)], 1).astype(">u8")
    return [r.tobytes() for r in table]


def signatures(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[rows, TREES * DEPTH] MinHash values of the rows that have shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), _K), np.uint32)
    for k in range(_K if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(h * _FACTORS[k] + _TERMS[k], starts) >> np.uint64(32)
    return out


def sign_documents(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, key, n, signature) per row; a text without words has n = 0 and no signature."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                first, h = shingle_sets(data, offsets, i, j, size)
                n = np.diff(first)
                made = iter(signatures(first, h))
                blobs = [next(made).astype("<u4").tobytes() if c else None for c in n.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(set_keys(first, h), pa.binary()),
                     pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["_id", "key", "n", "signature"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, key binary, n bigint, signature binary")


def trie_rows(classes: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, key, s0, s1, n): every class's label prefixes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, _K)
            rows = len(sig)
            bits = np.packbits((sig & 1).astype(np.uint8), axis=1).view("<i8")
            label = sig.reshape(rows, TREES, DEPTH)[:, :, :depth].astype(np.uint64)
            prefix = np.zeros((rows, TREES), np.uint64)
            for d in range(depth):
                prefix = mix(prefix + label[:, :, d] + np.uint64(1))
            take = pa.array(np.repeat(np.arange(rows), TREES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES, dtype=np.int32), rows)), pa.array(prefix.ravel().view(np.int64)),
                 batch.column("key").take(take), pa.array(np.repeat(bits[:, 0], TREES)),
                 pa.array(np.repeat(bits[:, 1], TREES)), batch.column("n").take(take)],
                names=["tree", "prefix", "key", "s0", "s1", "n"])

    return classes.select("key", "n", "signature").mapInArrow(
        run, "tree int, prefix bigint, key binary, s0 bigint, s1 bigint, n bigint")


def dealt(rows: DataFrame, by: list[str], slice_size: int, name: str, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` (``counted``: a narrower table with the same groups) laid out so that those with equal ``by`` lie together, sorted.

    A group of more than ``slice_size`` rows is cut into slices by a hash of the
    key, and dealt out as pairs of slices: ``part`` numbers the pair, ``blk`` is
    a row's own slice, ``cuts`` the number of slices.  Any two rows of a group
    meet in one part, and no part has more than two slices."""
    large = (rows if counted is None else counted).groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > slice_size)
    large = written(large.select(*by, F.ceil(F.col("c") / slice_size).cast("int").alias("cuts")), name)
    cut = rows.join(large, by, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("blk", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cut = cut.withColumn("part", F.least("blk", "other") * F.col("cuts") + F.greatest("blk", "other")).drop("other")
    order = [*by, "part"]
    return cut.repartition(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def by_run(df: DataFrame, by: list[str], work, schema: str, rows_held: int) -> DataFrame:
    """``work(run, cross)`` for every run of equal ``by`` and part, batches of runs at a time.

    ``cross``: only rows of different ``blk`` are to be compared (the others
    meet in a part of their own)."""

    def cuts_of(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows - 1, bool)
        for c in [*by, "part"]:
            column = table.column(c).combine_chunks()
            change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    def finished(table: pa.Table, edges: np.ndarray):
        part, cuts = table.column("part").to_numpy(), table.column("cuts").to_numpy()
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if j - i > 1:
                yield work(table.slice(i, j - i), part[i] // cuts[i] != part[i] % cuts[i])

    def merged(found: list[pa.Table]):
        if found:
            yield from pa.concat_tables(found).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is not None and held.num_rows >= rows_held:
                held = held.combine_chunks()
                edges = cuts_of(held)
                yield from merged(list(finished(held, edges[:-1])))
                held = held.slice(edges[-2])  # the last run may go on
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            yield from merged(list(finished(held, cuts_of(held))))

    return df.mapInArrow(run, schema)


def may_link(s: np.ndarray, n: np.ndarray, rows: slice, threshold: float, agree: int) -> np.ndarray:
    """[rows, all] whether sketches and sizes allow the threshold."""
    apart = np.bitwise_count(s[rows, None, 0] ^ s[None, :, 0])
    apart += np.bitwise_count(s[rows, None, 1] ^ s[None, :, 1])  # at most 128
    return (apart <= _K - agree) & sizes_allow(n, rows, threshold)


def sizes_allow(n: np.ndarray, rows: slice, threshold: float) -> np.ndarray:
    """[rows, all] whether sizes alone allow the threshold."""
    low, high = np.minimum(n[rows, None], n[None, :]), np.maximum(n[rows, None], n[None, :])
    return low >= threshold * high - 1e-9


def blocks(m: int, size: int = 256):
    return [slice(at, min(at + size, m)) for at in range(0, m, size)]


def spread_labels(m: int, linked) -> np.ndarray:
    """Least index that links connect each row with; linked(rows) gives [rows, all]."""
    label = np.arange(m)
    while True:
        before = label.copy()
        for rows in blocks(m):
            near = np.where(linked(rows), label[None, :], m).min(1)
            label[rows] = np.minimum(label[rows], near)
        label = label[label]
        # a row takes over what its label was linked with, and hands it on
        np.minimum.at(label, before, label)
        if (label == before).all():
            return label


def run_columns(table: pa.Table):
    s = np.stack([table.column(c).to_numpy() for c in ("s0", "s1")], 1).view(np.uint64)
    return s, table.column("n").to_numpy(), table.column("blk").to_numpy()


def candidate_edges(rows: DataFrame, threshold: float, slice_size: int) -> DataFrame:
    """Distinct (u, v) that connect all keys which share a prefix and pass the sketch.

    Of a run's candidate pairs only a star per connected part leaves the task,
    so a group of near copies gives as many edges as it has members."""
    agree = sketch_agreement(threshold)

    def star(table: pa.Table, cross: bool) -> pa.Table:
        s, n, blk = run_columns(table)

        def linked(part: slice) -> np.ndarray:
            ok = may_link(s, n, part, threshold, agree)
            return ok & (blk[part, None] != blk[None, :]) if cross else ok

        label = spread_labels(len(n), linked)
        member = np.flatnonzero(label != np.arange(len(n)))
        keys = table.column("key").combine_chunks()
        return pa.table({"u": keys.take(pa.array(member)), "v": keys.take(pa.array(label[member]))})

    by = ["tree", "prefix"]
    return by_run(dealt(rows, by, slice_size, "prefixes"), by, star, "u binary, v binary", 1 << 16).distinct()


def shingle_members(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str,
                    size: int) -> DataFrame:
    """(key, members) for the keys of ``nodes``: their whole sets as sorted 64-bit hashes."""
    reps = nodes.join(classes.select("key", "rep"), "key")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(reps, F.col("_id").eqNullSafe(F.col("rep"))).select("key", "_text")

    def sets(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            wanted = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                first, h = shingle_sets(data, offsets, i, j, size)
                keep = [r for r, key in enumerate(set_keys(first, h)) if key == wanted[i + r]]  # of rows with one id
                yield pa.RecordBatch.from_arrays(
                    [pa.array([wanted[i + r] for r in keep], pa.binary()),
                     pa.array([h[first[r]:first[r + 1]].tobytes() for r in keep], pa.binary())], names=["key", "members"])

    return found.mapInArrow(sets, "key binary, members binary").groupBy("key").agg(F.first("members").alias("members"))


def exact_links(sets: list[np.ndarray], maybe: np.ndarray, threshold: float) -> np.ndarray:
    """[all, all] which of the pairs ``maybe`` reach the threshold on the whole sets."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    values, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    a, b = np.nonzero(np.triu(maybe, 1))
    links = np.zeros((m, m), bool)
    if len(a) * 25e-6 <= int(shared.sum()) * float(m) * m * 2e-10:  # a few pairs one by one, many by products
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    else:
        keep = shared[column]
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((m, m), np.float32)
        width = 2048
        for at in range(0, int(shared.sum()), width):
            i, j = np.searchsorted(column, [at, at + width])
            part = np.zeros((m, width), np.float32)
            part[owner[i:j], column[i:j] - at] = 1
            total += part @ part.T
        common = total[a, b].astype(np.int64)  # exact: counts far below 2 ** 24
    good = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
    links[a[good], b[good]] = links[b[good], a[good]] = True
    return links


def verified(edges: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int,
             threshold: float, slice_size: int) -> DataFrame:
    """(key, others, v): per key of a candidate group, the rows of all classes that
    it is truly linked to, and a class of the same part that links connect it with.

    Groups (components of the candidate edges) are compared on whole sets, part
    by part; sums over the parts of a key are left to the caller."""
    groups = written(components(edges).select(F.col("node").alias("key"), "root"), "groups")
    members = written(shingle_members(groups.select("key"), classes, docs, id_col, text_col, size), "members")
    light = classes.select("key", "copies", "n")
    rows = groups.join(light, "key").join(members, "key")

    def compare(table: pa.Table, cross: bool) -> pa.Table:
        n, blk = table.column("n").to_numpy(), table.column("blk").to_numpy()
        m = len(n)
        maybe = np.concatenate([sizes_allow(n, part, threshold) for part in blocks(m)])
        if cross:
            maybe &= blk[:, None] != blk[None, :]
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("members")]
        links = exact_links(sets, maybe, threshold)
        others = links @ table.column("copies").to_numpy()
        label = spread_labels(m, lambda part: links[part])
        keys = table.column("key").combine_chunks()
        return pa.table({"key": keys, "others": pa.array(others.astype(np.int64)), "v": keys.take(pa.array(label))})

    return by_run(dealt(rows, ["root"], slice_size, "large-groups", groups), ["root"], compare,
                  "key binary, others bigint, v binary", 4096)


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id",
                   text_col: str = "text", recall: float = RECALL,
                   slice_size: int = SLICE) -> DataFrame:
    """(id, class_id, n_links, set_size) for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``threshold`` (words: runs of characters
    other than space and U+0009..U+000D, as they stand; a shorter text is one
    shingle).  n_links counts the other rows a row is linked to, copies
    included; class_id is the smallest id of all rows that links connect.
    Null texts, empty ones and those of white space alone have no shingles, no
    links, and their own id as class.  Rows that repeat an id are rows of their
    own; null ids are never a class id unless a class has no other.  An empty
    table gives an empty result; other columns play no part.
    """
    prepare(docs.sparkSession)
    signed = written(sign_documents(docs, id_col, text_col, size), "signatures")
    classes = written(signed.where(F.col("n") > 0).groupBy("key").agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("signature").alias("signature")), "classes")
    edges = candidate_edges(trie_rows(classes, depth_for(threshold, recall)), threshold, slice_size)
    found = written(verified(edges, classes, docs, id_col, text_col, size, threshold, max(2, slice_size // 2)), "verified")
    plain = classes.select("key", "rep", "copies")
    degree = found.groupBy("key").agg(F.sum("others").alias("others"))
    member = components(found.select(F.col("key").alias("u"), "v")).select(F.col("node").alias("key"), "root")
    linked = member.join(plain.select("key", "rep"), "key")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("lowest"))
    linked = linked.join(lowest, "root").join(degree, "key").select(
        F.hex("key").alias("k"), "lowest", "others")
    # hexadecimal keys: both sides of the join get exchanges that may be split
    sized = plain.select(F.hex("key").alias("k"), "rep", "copies").join(linked, "k", "left")
    rows = signed.select("_id", F.when(F.col("n") > 0, F.hex("key")).alias("_k"), "n")
    joined = rows.join(sized, F.col("_k") == F.col("k"), "left")
    links_of = F.when(F.col("k").isNull(), F.lit(0)).otherwise(
        F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    return joined.select(F.col("_id").alias(id_col), F.coalesce("lowest", "rep", "_id").alias("class_id"),
                         links_of.cast("long").alias("n_links"), F.col("n").alias("set_size"))
