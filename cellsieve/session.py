"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every job here relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local runs that name none."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return named or current
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="cellsieve-")
    context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back: ends the lineage, survives executor loss, and
    unlike a checkpoint keeps column pruning, filter pushdown and size statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
