"""Event-time operators for streams; each takes and gives a DataFrame, streaming or not. An extension: the batch engine needs none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: int = 1, pattern: str = "events*.parquet") -> DataFrame:
    """Events as they arrive in a folder, so many files a batch. Time is an instant, as watermarks ask."""
    df = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once, repeats within the watermark left out."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def streaks(events: DataFrame, kind: str = "purchase") -> DataFrame:
    """(user_id, longest): each user's longest run of one kind of event so far; state is two numbers a user."""

    def step(key, batches, state: GroupState):
        now, longest = state.get if state.exists else (0, 0)
        for pdf in batches:
            for hit in (pdf.sort_values(["ts", "event_id"])["event_type"] == kind).tolist():
                now = now + 1 if hit else 0
                longest = max(longest, now)
        state.update((now, longest))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [longest]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, longest long", "now long, longest long", "update", GroupStateTimeout.NoTimeout)


def upsert(path: str, key: str):
    """A foreachBatch sink that writes each batch to its own folder, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
