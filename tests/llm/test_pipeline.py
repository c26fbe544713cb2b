import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.conftest import WORD
from tests.llm.test_dedup import groups_by_hand, removed_by_hand
from tests.llm.test_tokens import check_packing
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_on_the_given_table(spark):
    """Every stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "jaccard_join", "substring_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
        docs = written(stage(spark, docs, SF), name)
        if name == "best_fit_packing":
            check_packing(before, docs.collect(), 1024, 2)
            continue
        assert docs.columns == columns
        after = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
        if name == "quality_classifier":
            assert set(after) < set(before) and len(after) > 0.7 * len(before)
        elif name == "exact_dedup":
            least = defaultdict(list)
            for i, t in before:
                least[t].append(i)
            assert after == sorted((min(ids), t) for t, ids in least.items())
        elif name == "jaccard_join":
            heads = {i for i, c, _ in groups_by_hand(before, 0.8, 5) if i == c}
            assert after == [(i, t) for i, t in before if i in heads]
        else:
            kept = removed_by_hand([t for _, t in before], 35)
            # the same words as by hand; what loses nothing keeps its spaces and lines
            assert [(i, " ".join(re.findall(WORD, t or ""))) for i, t in after] == [(i, k[0]) for (i, _), k in zip(before, kept)]
            clean = [(i, t) for (i, t), k in zip(before, kept) if k[2] == 0]
            assert clean and set(clean) <= set(after)
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0


def test_stages_bear_odd_rows(spark, make, corpus):
    docs = make(corpus).withColumn("lang", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() > 0
        if name != "best_fit_packing":
            assert {"_block", "key", "lang"} <= set(docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        empty = make([(1, "a")]).where("doc_id < 0")
        assert stage(spark, empty, SF).count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 14))
    assert entry.queries()["pipeline"](spark, SF).count() > 0
