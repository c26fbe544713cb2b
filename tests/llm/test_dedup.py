import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORD
from tidemark.llm import exact, jaccard, substring
from tidemark.llm.components import components


def words(text):
    return re.findall(WORD, text or "")


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(make, corpus, largest, collide):
    hash_of = (lambda t: F.substring(F.md5(t), 1, 1)) if collide else exact.content_hash
    if collide:  # two hexadecimal digits decode to bytes
        hash_of = lambda t: F.concat(F.lit("0"), F.substring(F.md5(t), 1, 1))
    got = exact.exact_groups(make(corpus), largest=largest, hash_of=hash_of,
                             carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in corpus:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        want[i, keep, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["sha"]) for r in got) == want


def removed_by_hand(texts, window):
    starts = Counter()
    split = [words(t) for t in texts]
    for w in split:
        for k in range(len(w) - window + 1):
            starts[tuple(w[k:k + window])] += 1
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


@pytest.mark.parametrize("window, bits", [(35, 44), (3, 44), (1, 44), (20, 33)])
def test_remove_repeats(make, corpus, window, bits):
    rows = substring.remove_repeats(make(corpus), window=window, bits=bits, carry=["n", "_text"]).collect()
    want = Counter((i, *x) for (i, _), x in zip(corpus, removed_by_hand([t for _, t in corpus], window)))
    assert Counter((r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in rows) == want
    assert {(r["n"], r["_text"]) for r in rows} == {(1, "y")}


def test_window_repeated_inside_one_document(make):
    text = " ".join(["a", "b"] * 30)
    row = substring.remove_repeats(make([(1, text), (2, "c " + " ".join("defgh"))]), window=4).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in row} == {(1, 60), (2, 0)}


def test_levels_double():
    for window in (1, 9, 10, 35, 100):
        ladder = substring.lengths(window)
        assert ladder[-1] == window and ladder[0] <= 9
        assert all(b <= 2 * a and a < b for a, b in zip(ladder, ladder[1:]))


def groups_by_hand(rows, threshold, size):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[root(k)].append(rows[k][0])
    out = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [x for x in members[root(k)] if x is not None]
        out[i, min(ids) if ids else None, links[k]] += 1
    return out


@pytest.mark.parametrize("threshold, size, slice_size", [(0.8, 5, 2048), (0.8, 5, 2), (0.6, 2, 3)])
def test_jaccard_groups(make, corpus, threshold, size, slice_size):
    got = jaccard.jaccard_groups(make(corpus), threshold, size, slice_size=slice_size).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == groups_by_hand(corpus, threshold, size)


def test_every_pair_of_a_common_prefix_meets_in_slices(make):
    """A group of near copies that is dealt out to slices loses no link."""
    common = " ".join(f"w{k}" for k in range(80))
    rows = [(k, f"{common} end{k}") for k in range(24)]
    got = jaccard.jaccard_groups(make(rows), slice_size=4).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 23)}


def test_forest_depth_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        depth = jaccard.depth_for(threshold, 0.999)
        reached = 1 - (1 - threshold ** depth) ** jaccard.TREES
        assert reached >= 0.999 or depth == 1
        assert depth == jaccard.DEPTH or 1 - (1 - threshold ** (depth + 1)) ** jaccard.TREES < 0.999


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_tables(make, spark):
    empty = make([(1, "a")]).where("doc_id < 0")
    assert exact.exact_groups(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert jaccard.jaccard_groups(empty).count() == 0


def test_queries_on_the_given_tables(spark):
    """op1 and op2 against brute force over whole sf0.001."""
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    got = QUERIES["op1_jaccard_join"](spark, sf).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == groups_by_hand(docs, 0.8, 5)
    got = QUERIES["op2_substring_dedup"](spark, sf).collect()
    want = removed_by_hand([t for _, t in docs], 35)
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {
        (i, n, g, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (k, n, g) in zip(docs, want)}


def test_window_hash_does_not_depend_on_place():
    from tidemark.llm.common import span_hashes

    v = np.arange(50, dtype=np.uint64) % np.uint64(5)
    h = span_hashes(v, np.arange(41), 10)
    assert len(np.unique(h)) == 5 and (h[5:] == h[:-5]).all()


def test_sketch_bound_is_the_binomial_tail():
    """A pair at the threshold is dropped with a chance of at most 1e-9."""
    from math import comb

    from tidemark.llm import jaccard

    for threshold in (0.5, 0.8, 0.95):
        agree, p = jaccard.sketch_agreement(threshold), (1 + threshold) / 2
        assert sum(comb(128, k) * p ** k * (1 - p) ** (128 - k) for k in range(agree)) <= 1e-9
        assert sum(comb(128, k) * p ** k * (1 - p) ** (128 - k) for k in range(agree + 1)) > 1e-9


def test_layout_is_kept_where_nothing_goes(make, corpus):
    docs = make(corpus)
    joined = {(r["doc_id"], r["kept_text"], r["n_removed"]) for r in substring.remove_repeats(docs).collect()}
    laid = substring.remove_repeats(docs, layout=True).collect()
    assert {(r["doc_id"], " ".join(re.findall(WORD, r["kept_text"])), r["n_removed"]) for r in laid} == joined
    source = defaultdict(set)
    for i, t in corpus:
        source[i].add(t or "")
    for r in laid:
        if r["n_removed"] == 0:
            assert r["kept_text"] in source[r["doc_id"]]
