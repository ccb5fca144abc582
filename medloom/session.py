"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every job here. Partition counts are left to AQE: a high initial
# number is coalesced down at run time, so the same value serves a laptop and a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Scoring and text work is heavy per row, so small shuffles keep more tasks than by default.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "medloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python finds it from any folder; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_medloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="medloom-src-"), "package"), "zip", os.path.dirname(home), os.path.basename(home))
    sc.addPyFile(archive)  # the driver serves it; no executor reads the driver's folder
    sc._medloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local master
    (tests, a laptop) may fall back to a private folder; anywhere else it must be shared. A written
    table survives lost executors, and unlike a checkpointed RDD it comes back with its true size,
    so the joins that follow are planned by size.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="medloom-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
