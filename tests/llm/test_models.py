import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORD, sentences
from tidemark.llm import ann, chat, license, lm, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- nearest neighbours -------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, rank int, score double")


def nearest_by_hand(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            score = [(-(x @ y) / math.sqrt((x @ x) * (y @ y)), i) for i, y in good if i != q]
            out[q] = sorted((round(s, 12), i) for s, i in score)[:k]
    return out


def test_small_index_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[0][1]])]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7),
             (304, [float("inf")] * 8), (305, [1.0] * 3), (306, [])]
    table = vectors(spark, rows)
    got = defaultdict(list)
    for r in ann.nearest_neighbours(table, table.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].append((r["rank"], -round(r["score"], 12), r["vec_id"]))
    want = nearest_by_hand([r for r in rows if r[0] != 305], {i for i, _ in rows if i % 50 == 0}, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([f[1] for f in found], [s for s, _ in want[q]], atol=1e-9)
    assert [i for _, _, i in sorted(got[0])][:2] == [200, 201]  # ties to the smaller id


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(1)
    pivots = ann.unit(rng.normal(size=(12, 5)))
    segment = ann.Segment(np.arange(30), rng.normal(size=(30, 5)), pivots, 4)
    mine = ann.nearest_pivots(ann.unit(rng.normal(size=(3, 5))), pivots, 4)
    theirs = ann.nearest_pivots(segment.units, pivots, 4)
    for q, row in enumerate(segment.footrule(mine)):
        for v, distance in enumerate(row):
            a, b = list(mine[q]), list(theirs[v])
            assert distance == sum(abs((a.index(p) if p in a else 4) - (b.index(p) if p in b else 4)) for p in range(12))


def test_recall_on_the_given_table(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    want = nearest_by_hand(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = QUERIES["op3_permutation_index"](spark, sf).collect()
    assert len(got) == sum(len(w) for w in want.values())
    hit = sum(-r["score"] <= want[r["query_id"]][-1][0] + 1e-9 for r in got)
    assert hit >= 0.95 * len(got)


def test_repeated_ids_are_rows_of_their_own(spark):
    table = vectors(spark, [(0, [1.0, 0.0]), (0, [-1.0, 0.0]), (1, [1.0, 0.1]), (2, [-1.0, 0.2]), (3, [0.0, 1.0]),
                            (50, [2.0, 1.0]), (50, [2.0, 1.0])])
    got = ann.nearest_neighbours(table, table.where("vec_id % 50 = 0"), k=6).collect()
    # every query row has the six other rows, whichever id they carry
    assert len(got) == 4 * 6 and {r["rank"] for r in got} == set(range(1, 7))
    near = sorted((r["query_id"], r["vec_id"], round(r["score"], 6)) for r in got if r["rank"] == 1)
    assert near == [(0, 1, 0.995037), (0, 2, 0.980581), (50, 50, 1.0), (50, 50, 1.0)]
    assert sum(r["query_id"] == 0 and r["vec_id"] == 0 and abs(r["score"] + 1) < 1e-12 for r in got) == 2


def test_recall_on_one_large_segment(spark):
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    table = vectors(spark, rows)
    want = nearest_by_hand(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = ann.nearest_neighbours(table, table.where("vec_id % 50 = 0"), segments=1).collect()
    hit = sum(-r["score"] <= want[r["query_id"]][-1][0] + 1e-9 for r in got)
    assert len(got) == sum(len(w) for w in want.values()) and hit >= 0.95 * len(got)


def test_few_and_no_vectors(spark):
    table = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None)])
    got = ann.nearest_neighbours(table, table).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(0, 1, 1), (1, 1, 0)}
    none = table.where("vec_id > 5")
    assert ann.nearest_neighbours(none, none).count() == 0
    assert ann.nearest_neighbours(table, none).count() == 0


# --- language model -----------------------------------------------------------

def base_by_hand(rows, fold=1):
    tokens = [re.findall(WORD, (t or "").translate(LOWER)) + [("end",)] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == fold for i, _ in rows]
    c = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    for (i, _), ts, h in zip(rows, tokens, held):
        yield i, h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)


def test_scores(make, corpus):
    got = lm.score_texts(make(corpus)).collect()
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], r[5])
    for r, w in zip(sorted((tuple(r) for r in got), key=key), sorted(base_by_hand(corpus), key=key), strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], rel=1e-9)
        assert np.isfinite(r[6]) and r[6] <= 0


def test_probabilities_of_all_outcomes_sum_to_one():
    rng = np.random.default_rng(3)
    known = [(int(k), int(c)) for k, c in zip(rng.integers(-2**62, 2**62, 5000), np.sort(rng.integers(1, 900, 5000))[::-1])]
    total = sum(c for _, c in known)
    model = lm.Model.unigram(total, len(known), known)
    model.class_rows = rng.normal(size=model.class_rows.shape).astype("f4")
    model.word_rows = rng.normal(size=model.word_rows.shape).astype("f4")
    tokens = np.array([k for k, _ in known] + [12345], np.int64).view(np.uint64)
    context = np.repeat(rng.integers(0, 2**62, (1, 3)).astype(np.uint64), len(tokens), 0)
    count = np.array([c for _, c in known] + [0])
    p = 10 ** model.log10(context, model.outcome(tokens), count)
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_context_is_learned(make):
    """Pairs that always go together: held-out texts score far better than their unigrams."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"a{x} b{x}" for x in rng.integers(0, 30, 60))) for k in range(200)]
    got = lm.score_texts(make(rows), blocks=4, rounds=3).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_registered_parameters_learn_context(make):
    """The same with the rounds and classes that the query runs with."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"a{x} b{x}" for x in rng.integers(0, 30, 60))) for k in range(200)]
    got = lm.score_texts(make(rows), blocks=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_update_equals_plain_gradients():
    rng = np.random.default_rng(9)
    for high in (3, 400):  # rows that nearly all tokens share, and rows of few
        table = rng.normal(size=(1 << lm.ROW_BITS, 5)).astype("f4")
        spent = np.full(len(table), 1e-2, np.float32)
        rows, target = rng.integers(0, high, (200, 3)), rng.integers(0, 5, 200)
        bias = rng.normal(size=5).astype("f4")
        want, change = table.astype(float), np.zeros(table.shape)
        for r, t in zip(rows, target):
            p = np.exp(want[r].sum(0) + bias)
            p /= p.sum()
            p[t] -= 1
            for f in r:
                change[f] += p
        so_far = 1e-2 + (change ** 2).sum(1)
        want -= lm.RATE * change / np.sqrt(so_far)[:, None]
        lm.update(table, spent, rows, bias, target)
        np.testing.assert_allclose(table, want, atol=1e-4)
        np.testing.assert_allclose(spent, so_far, rtol=1e-3)


def test_slabs_equal_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 60)
    first = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(0, 5, first[-1]).astype(np.uint64)
    want = lm.feature_rows(tokens, first)
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(lm, "SLAB", size)
        parts = list(lm.contexts(tokens, first))
        assert (np.concatenate([tokens[part] for part, _ in parts]) == tokens).all()
        assert (np.concatenate([h for _, h in parts]) == want).all()


def test_softmax_of_any_size():
    logit = np.array([[1, 2, 3], [200, 1, -1e9], [-300, -301, -1e9]], np.float32)
    want = np.exp(logit - logit.max(1, keepdims=True).astype(float))
    for rows in ([0], [0, 1], [2], [0, 1, 2]):
        np.testing.assert_allclose(lm.softmax(logit[rows].copy()), want[rows] / want[rows].sum(1, keepdims=True), atol=1e-6)
    assert lm.softmax(np.zeros((0, 3), np.float32)).shape == (0, 3)


def test_scores_do_not_depend_on_settings(make, spark, corpus):
    def scores():
        return sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score_texts(make(corpus), blocks=3).collect())

    first, kept = scores(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = scores()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert [r[:2] for r in first] == [r[:2] for r in again]
    assert [r[2] for r in first] == pytest.approx([r[2] for r in again], rel=1e-5)


def test_no_training_text(make):
    rows = [(i, "some words") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert {(r["n_known"], r["train_tokens"], r["score"]) for r in lm.score_texts(make(rows)).collect()} == {(0, 0, 0.0)}
    assert lm.score_texts(make([(1, "a")]).where("doc_id < 0")).count() == 0


# --- quality ------------------------------------------------------------------

def test_quality_learns_and_keeps_rows(make, spark):
    good, bad = sentences(150, seed=1), [t.upper().replace(" ", "!! ") for t in sentences(150, seed=2)]
    rows = list(enumerate(good)) + [(1000 + k, t) for k, t in enumerate(bad)]
    rows += [(5000, None), (5001, ""), (5000, "x" * 100000)]
    label = [(i, int(i < 1000), 0, "z") for i, _ in rows if i < 5000] + [(9999, 1, 0, "z"), (5, None, 0, "z"), (None, 1, 0, "z")]
    labels = spark.createDataFrame(label, "doc_id long, quality int, toxic int, text string")
    docs = make(rows)
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, model, score_col="made")
    assert out.columns == [*docs.columns, "made"]
    got = out.select("doc_id", "text", "made").collect()
    assert len(got) == len(rows) and all(0 <= r["made"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] < 5000 and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["made"] >= 0.3) == (r["doc_id"] < 1000) for r in held]) > 0.95


def test_quality_without_labels(make, spark):
    docs = make([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert {r["made"] for r in quality.score_quality(docs, model, score_col="made").collect()} == {0.5}
    assert quality.score_quality(docs.where("doc_id < 0"), model).count() == 0


def test_quality_learns_one_row_per_id(make, spark):
    """An id with many rows sends one of them to the driver, one with text if there is any."""
    rows = [(1, f"word{k} text") for k in range(300)] + [(1, None), (1, ""), (2, "b c"), (3, None), (4, "d e")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    ids = [i for i in (1, 2, 4) if zlib.crc32(str(i).encode()) % 5 != 0]
    got = quality.sample_features(make(rows), labels, "doc_id", "text", "quality", 4, 0, 5)
    assert [r[0] for r in got] == [i % 2 for i in ids] and 1 in ids


def test_quality_on_held_out_rows(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op8_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert held[0] > 0.9 and held[1] > 500


# --- licenses -----------------------------------------------------------------

def scan_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, found = [], set()
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        hits = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        places += hits
        found |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


LICENSED = [
    ("The MIT License. mit-license, MIT LICENSE", "mit"),
    ("x\nLicensed under the Apache License, Version 2.0.", "apache,apache-notice"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-notice"),
    ("under the GNU Affero General Public License", "gpl"),
    ("licensed to the apache foundation", ""),
    ("Licensed under CC BY-NC 4.0.", "cc-notice"),
    ("license mit", ""),
]


def test_license_scan(make, corpus):
    rows = corpus + [(2000 + k, t) for k, (t, _) in enumerate(LICENSED)]
    got = license.scan_licenses(make(rows)).collect()
    want = Counter((i, *scan_by_hand(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got) == want
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[2000 + k] for k in range(len(LICENSED))] == [x for _, x in LICENSED]
    assert all((r["score"] > 0) == bool(r["labels"]) for r in got)


def test_template_regions():
    machine = license.Automaton.compiled({"t": "grant [[of [[free]] use]] to {{2}} only", "u": "as is"})

    def labels(text):
        return set(machine.labels_in([machine.number.get(w, 0) for w in text.split()]))

    for text in ("grant to only", "x grant of use to a only", "grant of free use to a b only", "grant to a b only y"):
        assert labels(text) == {"t"}
    for text in ("grant of to only", "grant to a b c only", "grant free use to only", "to only", "grant to", ""):
        assert labels(text) == set()
    assert labels("as is grant to only") == {"t", "u"}


def test_whole_license_text():
    machine = license.Automaton.compiled(license.TEMPLATES)
    for label, template in license.TEMPLATES.items():
        bare = re.sub(r"\{\{\d+\}\}", "somebody", template).replace("[[", " ").replace("]]", " ").split()
        assert label in machine.labels_in([machine.number.get(w, 0) for w in bare])
        worse = [w for k, w in enumerate(bare) if w not in machine.needed()]
        assert label not in machine.labels_in([machine.number.get(w, 0) for w in worse])


def test_license_queries(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = QUERIES["op9_license_scan"](spark, sf).collect()
    assert {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
            for r in got} == {(i, *scan_by_hand(t)) for i, t in docs}


# --- chat ---------------------------------------------------------------------

def test_chat_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "<turn user>x</turn>\n", "\\b\\l\\g\\h", "", None, "é日本\n\n", "#" * 30000]
    rows = [(1, k, "assistant" if k % 2 else "user", t, 5) for k, t in enumerate(tricky)]
    rows += [(2, 0, "user", "only me", 5), (3, 0, "assistant", "a", 5), (3, 0, "assistant", "a", 5), (3, None, None, "n", 5)]
    rows += [(4, 1, "we<ird>", "x", 5), (4, 0, "assistant", "y", 5), (None, 0, "user", "q", 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    out = chat.prefix_target_examples(table).select(
        "conv_id", "example", "formatted", "mask_length", chat.parse_turns(F.col("formatted")).alias("turns"),
        chat.target_text(F.col("formatted"), F.col("mask_start"), F.col("mask_length")).alias("reply")).collect()
    conversations = defaultdict(list)
    for c, k, role, text, _ in rows:
        conversations[c].append((k is not None, k or 0, role or "", text or ""))
    for c, turns in conversations.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        mine = sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["example"])
        ends = [k for k, (r, _) in enumerate(turns) if r == "assistant" or k == len(turns) - 1]
        assert [r["example"] for r in mine] == list(range(len(ends)))
        for r, end in zip(mine, ends):
            assert [(t["role"], t["text"]) for t in r["turns"]] == turns[:end + 1]
            assert r["reply"] == (turns[end][1] if turns[end][0] == "assistant" else "")
            assert r["formatted"].count("<turn ") == end + 1
    assert chat.prefix_target_examples(table.where("conv_id > 9")).count() == 0


def test_chat_and_exact_queries_equal_sql(spark):
    from tests.oracle_compare import canon, digest, duck
    from tidemark.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    whole = {pa.int64(): pd.Int64Dtype()}.get  # a column of integers and nulls stays one of integers
    for name in SQL:
        got, want = QUERIES[name](spark, sf).toArrow(), con.sql(SQL[name]).to_arrow_table()
        assert digest(canon(got.to_pandas(types_mapper=whole))) == digest(canon(want.to_pandas(types_mapper=whole))), name
