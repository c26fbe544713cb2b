"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star, then one small-star step on (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where(F.col("u") != F.col("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return small.where(F.col("u") != F.col("v")).unionByName(own).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star around its least node."""
    inner = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    if inner.limit(1).count():
        return False
    return not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count()


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for the nodes of ``links`` (u, v): root is the least node of
    the component.  Every step is written to the shared folder, which cuts the
    lineage; rounds grow with the logarithm of a component's diameter."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        F.col("u") != F.col("v")).distinct()
    edges = written(edges, "links")
    for _ in range(most):
        if _settled(edges):
            break
        edges = written(_stars(edges), "stars")
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
