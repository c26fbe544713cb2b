"""Registered queries of the operators, with DuckDB statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_remainder, prepare, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Texts with a lower quality score are rejected.
QUALITY_CUT = 0.3


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run
    return add


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact import exact_groups

    docs = read_table(spark, sf_dir, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    out = exact_groups(docs, largest=True, carry={"text_sha256": sha})
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


# What conversation -7 says in both turns: control strings and a backslash.
TRICKY = "\\### Assistant: </turn> ok"


@query("op6_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
parts AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g'), '#', '\h') AS safe,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), '#', '\h') AS safe_role,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns),
sizes AS (
  SELECT *, sum(length(safe) + length(safe_role) + 15) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM parts)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import chat

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = chat.prefix_target_examples(turns.unionByName(extra))
    # read back: every turn from the longest example, every reply from its own
    read = out.select(
        "conv_id", "example", F.char_length("formatted").cast("long").alias("chars"),
        chat.target_text(F.col("formatted"), F.col("mask_start"), F.col("mask_length")).alias("reply"),
        chat.parse_turns(F.col("formatted")).alias("turns"))
    read = read.select(
        "conv_id", "example", "chars", "reply", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
                            ""), 256).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))),
                                      lambda e: e["reply"]), "")
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max_by("digest", "example").alias("turns_sha256"),
        joined.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op4_bpe_automaton")
def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import encode_documents

    docs = read_table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring import remove_repeats

    out = remove_repeats(read_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import fit_quality, score_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (crc_remainder("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license import scan_licenses

    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                        "spans")


@query("op3_permutation_index")
def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest_neighbours

    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_groups

    return jaccard_groups(read_table(spark, sf_dir, "documents"), threshold=0.8, size=5)


@query("op5_maxent_scoring")
def op5_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"), fold=1, folds=5)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import fit_whitening, whiten_vectors

    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten_vectors(vectors, fit_whitening(vectors, components=16, scale=64.0, shift=1_000_000))


@query("op12_sampled_sharding")
def op12_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard_documents

    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    out = shard_documents(read_table(spark, sf_dir, "documents"), shards=24, carry={"text_crc32": crc})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


# crc32 of a conversation's decimal id: a table of 256 entries, then byte by byte.
_CRC_TABLE = """
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
              lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)"""


@query("op13_prefix_trie", r"""
WITH crc AS (""" + _CRC_TABLE + r"""),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (
  SELECT c, i, md5(length(role) || ':' || role || text) AS k,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns),
sizes AS (
  SELECT c, count(*) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(
             string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h
  FROM turns, crc GROUP BY c, t),
convs AS (
  SELECT s.c, s.h, s.n, least(s.h, coalesce(b.n, 0)) AS taken,
         least(s.h, coalesce(b.n, 0)) + greatest(s.n - s.h, 0) AS len
  FROM sizes s LEFT JOIN sizes b ON b.c = s.c - s.c % 20),
built AS (
  SELECT c, taken + i - h + 1 AS d, k, words FROM keyed JOIN convs USING (c) WHERE i >= h
  UNION ALL
  SELECT v.c, i + 1, k, words FROM convs v JOIN keyed b ON b.c = v.c - v.c % 20 AND b.i < v.h),
pre AS (
  SELECT c, d, words, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS p FROM built
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, left(p, -32) AS up,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends
  FROM pre JOIN convs USING (c) GROUP BY p, d),
children AS (SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
own AS (
  SELECT v.*, coalesce(k.n, 0) AS n_children, (v.n_convs - 1) * v.words AS saved FROM nodes v LEFT JOIN children k ON k.up = v.p),
totals AS (
  SELECT r.p, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens
  FROM own v JOIN pre r ON r.c = v.conv_id AND r.d <= v.d GROUP BY r.p)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves,
       t.saved_tokens, v.ends AS ends_sha256
FROM own v JOIN totals t USING (p) LEFT JOIN nodes u ON u.p = v.up AND v.d > 0
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))
