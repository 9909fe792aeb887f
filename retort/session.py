"""Session factory and the shared-folder checkpoint used by every iterative operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "retort", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every stage assumes: UTC, AQE with skew handling, Arrow transfer.

    On a cluster the master and memory come from spark-submit; ``cpus`` only matters when no master is set.
    """
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("RETORT_DRIVER_MEMORY", "12g"),
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that setting is unset (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="retort-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows go to the shared folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
