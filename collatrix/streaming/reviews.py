"""Review events as a stream: windowed counts with a watermark, and a per-session fold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from collatrix.session import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 1000) -> DataFrame:
    """The events table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events per window and type; events later than ``late`` are dropped."""
    timed = events.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


FOLDED = "session long, version int, recorded int, uncertain int, excluded int"


def fold_sessions(events: DataFrame) -> DataFrame:
    """The running state of each session: a version that grows with every event, and counts of outcomes."""
    kinds = ("click", "view")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, *counts = state.get if state.exists else (1, 0, 0, 0)
        for batch in batches:
            version += len(batch)
            for i, kind in enumerate(kinds):
                counts[i] += int((batch["event_type"] == kind).sum())
            counts[2] += int((~batch["event_type"].isin(kinds)).sum())
        state.update((version, *counts))
        yield pd.DataFrame([(key[0], version, *counts)], columns=["session", "version", "recorded", "uncertain", "excluded"])

    keyed = events.select(F.col("user_id").alias("session"), "event_type")
    return keyed.groupBy("session").applyInPandasWithState(step, FOLDED, "version int, a int, b int, c int", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there, then return its result table: the last batch in complete mode, else all batches.

    Batches are written to the shared folder, a folder each, so that a batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")
        last.append(number)

    running = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise RuntimeError(str(running.exception()))
    if not last:
        return spark.createDataFrame([], stream.schema)
    folder = f"{place}/rows/batch={max(last)}" if mode == "complete" else f"{place}/rows/batch=*"
    return spark.read.schema(stream.schema).parquet(folder)
