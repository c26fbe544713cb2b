"""Session construction and cluster-safe settings."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Rows per chunk for windows that are split by (series_id, chunk) so that one
# very long series is spread over many tasks.  Tests lower it to exercise the
# chunk borders.
CHUNK_CONF = "tidemark.chunk.rows"
DEFAULT_CHUNK_ROWS = 1 << 17


def get_session(master: str | None = None, partitions: int = 8, app: str = "tidemark") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def chunk_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK_ROWS)))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none and runs in one process (local tests) a
    scratch folder is created and registered.  On a cluster a folder of this
    machine would not be seen by the executors, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    local = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make ``tidemark`` importable in every Python worker of the session.

    Arrow UDFs reference functions of this package; executors (and local
    Python workers started from another working directory) need it on their
    path.  The package is zipped once per driver process and registered with
    ``addPyFile``, which distributes it through Spark itself.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", None):
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="tidemark-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "tidemark"), "zip", os.path.dirname(pkg_dir), "tidemark")
    sc.addPyFile(archive)
    sc._tidemark_shipped = archive
