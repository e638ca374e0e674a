"""Edges as a stream: windows with watermarks, seeds, and the last neighbours of nodes as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder of Parquet files as they come, with `ts` as a timestamp."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_scores(stream: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Of each window the number, mean and greatest of losses; events later than the watermark are dropped."""
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(at).agg(F.count("*").alias("n"), F.avg("value").alias("mean_loss"), F.max("value").alias("max_loss"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Of each user the sessions that pauses of `gap` end."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def distinct_events(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def seeds(stream: DataFrame, threshold: float) -> DataFrame:
    """P9 on a stream."""
    return stream.where(F.col("value") >= threshold)


def last_neighbours(ends: DataFrame, k: int) -> DataFrame:
    """W11, T7 on a stream of ends (node, other, t, event_id): (node, neighbours) for each node of a batch: its last k neighbours by event before the batch, oldest first.

    A node's state is the last k events, whatever it has seen.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        new = [row for pdf in batches for row in zip(pdf["t"].tolist(), pdf["event_id"].tolist(), pdf["other"].tolist())]
        yield pd.DataFrame({"node": [key[0]], "neighbours": [[o for _, _, o in held]]})
        state.update(tuple(map(list, zip(*sorted([*held, *new])[-k:]))))

    return ends.groupBy("node").applyInPandasWithState(update, "node long, neighbours array<long>", "t array<long>, event_id array<long>, other array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the streaming engine, as a table in memory: for tests and small folders."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
