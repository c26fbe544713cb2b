"""Exact deduplication: groups of equal texts by a 128-bit content hash.

DataFrame functions only.  One pass reduces every document to (hash, id);
the group sizes come from a partially aggregated ``groupBy``, so a group that
holds a third of all rows arrives as one row per task.  Groups of two or more
are then compared by bytes: the least and the greatest text of a group are
equal exactly when all its texts are.  A group that fails is a collision and
is grouped again by the texts themselves.

Joins use the hash's hexadecimal form, the groups its bytes: both join sides
then have exchanges of their own, which adaptive execution may split when one
group is much larger than the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes, in hexadecimal."""
    return F.md5(text)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False,
                 carry: dict[str, Column] | None = None,
                 hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(id, keep_id, group_size, *carry) for every row of ``docs``.

    Equal texts form a group (null counts as empty); the row with the smallest
    id stays (``largest``: the largest), that is, the rows whose id equals
    keep_id.  Rows that repeat an id are rows of their own; where the kept id
    repeats within a group, all its rows count as kept.  A null id is chosen
    only when the whole group has no other.  An empty table gives an empty
    result.  Other columns play no part, whatever their names; ``carry`` adds
    expressions over ``docs`` to the result.
    """
    pick = F.max if largest else F.min
    carry = carry or {}
    clean = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), clean.alias("_text"), hash_of(clean).alias("_k"),
                       F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("_row"))
    sizes = base.select("_id", F.unhex("_k").alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), pick("_id").alias("keep"))
    several = sizes.where(F.col("n") > 1).select(F.lower(F.hex("h")).alias("_k"))
    # only members of groups of two or more are looked at again
    members = written(base.select("_id", "_k", "_text", "_row").join(several, "_k", "left_semi"), "copies")
    collided = (
        members.groupBy(F.unhex("_k").alias("h")).agg(F.min("_text").alias("least"), F.max("_text").alias("most"))
        .where(F.col("least") != F.col("most")).select("h")
    )
    flagged = sizes.join(collided.withColumn("clash", F.lit(True)), "h", "left").select(
        F.lower(F.hex("h")).alias("_k"), "n", "keep", "clash")
    rows = base.select("_id", "_k", "_row").join(flagged, "_k", "left")
    whole = rows.where(F.col("clash").isNull()).select("_id", "_row", "keep", "n")
    apart = members.join(collided.select(F.lower(F.hex("h")).alias("_k")), "_k", "left_semi")
    by_text = apart.groupBy("_text").agg(F.count(F.lit(1)).alias("n"), pick("_id").alias("keep"))
    split = apart.join(by_text, "_text").select("_id", "_row", "keep", "n")
    return whole.unionByName(split).select(
        F.col("_id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        *[F.col("_row")[n].alias(n) for n in carry])
