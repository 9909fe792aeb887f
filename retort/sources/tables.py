"""The input tables by name: a path is only ever opened by Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def dealt(frame: DataFrame) -> DataFrame:
    """A frame read in no more splits than there are cores, dealt out evenly to them; a larger one stays as it lies.

    A small file may be one row group, which one task reads; that would be all the work of what follows.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() <= cores else frame


def table(spark: SparkSession, folder: str, name: str, deal: bool = False) -> DataFrame:
    """A table by name; with ``deal``, for work that is heavy for each row, see ``dealt``."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return dealt(found) if deal else found
