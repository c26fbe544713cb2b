"""Table, JSON and model sinks.

Result tables are written by Spark in parallel (partitioned by series when
asked); nothing is funnelled through the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.boosting import Booster, BoostParams, Tree
from tidemark.sources.series import components_to_wide


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, header: bool = True) -> None:
    """Write any result table (components, energy, quality, summary, predictions,
    importance, convergence) as parquet or CSV (A7)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def write_components_wide(components: DataFrame, path: str, fmt: str = "csv") -> None:
    """The wide decomposition layout (one column per component), per series folder."""
    write_table(components_to_wide(components), path, fmt, partition_by="series_id")


def write_json(df: DataFrame, path: str, nested: dict | None = None, mode: str = "overwrite") -> None:
    """Nested summaries as JSON lines (A8).  ``nested`` maps an output field to a
    list of columns gathered into a struct."""
    out = df
    for name, cols in (nested or {}).items():
        out = out.withColumn(name, F.struct(*[F.col(c) for c in cols])).drop(*cols)
    out.write.mode(mode).json(path)


def save_models(models, path: str, spark: SparkSession | None = None) -> None:
    """Saved models (A9): boosters, per step or joint, as two tables under
    ``path`` (``models``: one JSON line each; ``nodes``: one row per tree node),
    linear models as Spark ML folders ``step_h``."""
    if not models or not isinstance(models[0], Booster):
        for h, m in enumerate(models, start=1):
            m.write().overwrite().save(f"{path}/step_{h}")
        return
    spark = spark or SparkSession.getActiveSession()
    heads, nodes = [], []
    for k, m in enumerate(models):
        heads.append((k, json.dumps({"features": m.features, "edges": [e.tolist() for e in m.edges], "steps": m.steps,
                                     "params": asdict(m.params), "base": m.base.tolist(), "losses": m.losses,
                                     "status": m.status, "trees": len(m.trees)})))
        for number, t in enumerate(m.trees):
            live = [0]
            for i in live:  # grows: the children of inner nodes follow
                if t.column[i] >= 0:
                    live += [2 * i + 1, 2 * i + 2]
                nodes.append((k, number, i, int(t.column[i]), int(t.cut[i]), t.value[i].tolist(), float(t.gain[i])))
    spark.createDataFrame(heads, "model int, head string").write.mode("overwrite").parquet(f"{path}/models")
    spark.createDataFrame(nodes, "model int, tree int, node int, column int, cut int, value array<double>, gain double") \
        .write.mode("overwrite").parquet(f"{path}/nodes")


def load_models(path: str, steps: int | None = None, kind: str = "booster", spark: SparkSession | None = None) -> list:
    """What ``save_models`` wrote: ``kind`` "booster", or "linear" with its number of steps."""
    if kind == "linear":
        return [LinearRegressionModel.load(f"{path}/step_{h}") for h in range(1, steps + 1)]
    spark = spark or SparkSession.getActiveSession()
    models = []
    for r in sorted(spark.read.parquet(f"{path}/models").collect(), key=lambda r: r["model"]):
        head = json.loads(r["head"])
        params = BoostParams(**head["params"])
        size = (1 << (params.depth + 1)) - 1
        trees = [Tree(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros((size, len(head["steps"]))),
                      np.zeros(size)) for _ in range(head["trees"])]
        models.append(Booster(head["features"], [np.array(e, float) for e in head["edges"]], head["steps"], params,
                              np.array(head["base"], float), trees, head["losses"], head["status"]))
    for r in spark.read.parquet(f"{path}/nodes").collect():
        t = models[r["model"]].trees[r["tree"]]
        t.column[r["node"]], t.cut[r["node"]], t.value[r["node"]], t.gain[r["node"]] = r["column"], r["cut"], r["value"], r["gain"]
    return models
