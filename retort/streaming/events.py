"""Streams: windowed counts with late data, latest-wins state, and the work queue fed by files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_files(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window start, key, rows) for each window that the watermark has closed. Times without zone are read in the session's."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), key, "rows")


def sliding_average(events: DataFrame, value: str, time: str = "ts", key: str = "event_type", window: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window, slide).alias("w"), key).agg(F.avg(value).alias("mean"), F.count("*").alias("rows")).select(F.col("w.start").alias("start"), key, "mean", "rows")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "rows")


def deduplicated(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def carried_bindings(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with the last non-null value of its key so far, across micro-batches: the carry-forward fold on a stream."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[value].dataType.simpleString()
    key_kind, order_kind = events.schema[key].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        bound = []
        for v in rows[value]:
            last = last if pd.isna(v) else v
            bound.append(last)
        state.update((last,))
        yield pd.DataFrame({key: group[0], order: rows[order].to_numpy(), "bound": pd.Series(bound, dtype=object).to_numpy()})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {key_kind}, {order} {order_kind}, bound {kind}", f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def run_queue(pending: DataFrame, process, log: str, checkpoint: str) -> StreamingQuery:
    """Feeds new work items to ``process`` once each and appends what it returns to a log of attempts (Q1, Q6).

    A batch that is retried writes the same version, and the log's readers take the latest version of each item.
    """

    def step(batch: DataFrame, number: int) -> None:
        process(batch).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{log}/version={number}")

    return pending.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
