"""A corpus-cleaning pipeline over ``documents``.

Stages, in order: quality classifier, exact dedup, n-gram Jaccard join,
substring dedup, best-fit packing.  Each stage gets what its predecessor
kept, written as Parquet and read again; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, read_table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among ``docs``."""
    from tidemark.llm.quality import fit_quality, score_quality
    from tidemark.llm.queries import QUALITY_CUT

    prepare(spark)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, score_col="_tidemark_score").where(F.col("_tidemark_score") >= QUALITY_CUT).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the smallest id."""
    from tidemark.llm.exact import exact_groups

    prepare(spark)
    rows = exact_groups(docs, carry={c: F.col(c) for c in docs.columns if c != "doc_id"})
    return rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect stays: the smallest id."""
    from tidemark.llm.jaccard import jaccard_groups

    prepare(spark)
    rows = jaccard_groups(docs)
    heads = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_tidemark_head")).distinct()
    return docs.join(heads, F.col("doc_id").eqNullSafe(F.col("_tidemark_head")), "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows are cut out of the texts, which otherwise stay as they are;
    every document stays, n_chars follows its text."""
    from tidemark.llm.substring import remove_repeats

    prepare(spark)
    rows = remove_repeats(docs, layout=True,
                          carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece, with its place."""
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    prepare(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

# Training and adaptive search have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table of ``sf_dir``."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
