"""Streaming queries, run over all files that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.plans.registry import query
from collatrix.streaming.reviews import event_stream, fold_sessions, run_once, windowed_counts


@query(
    "stream_window_counts",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""",
)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, as a stream with a watermark."""
    found = run_once(windowed_counts(event_stream(spark, sf_dir)), f"windows_{uuid.uuid4().hex}", "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_session_fold",
    """SELECT user_id AS session, 1 + count(*) AS version, count(*) FILTER (WHERE event_type = 'click') AS recorded, count(*) FILTER (WHERE event_type = 'view') AS uncertain,
    count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS excluded FROM events GROUP BY user_id""",
)
def stream_session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each session that the stream's fold gives out."""
    found = run_once(fold_sessions(event_stream(spark, sf_dir)), f"sessions_{uuid.uuid4().hex}", "update")
    last = found.groupBy("session").agg(F.max_by(F.struct("*"), "version").alias("x")).select("x.*")
    return last.select("session", *[F.col(c).cast("long").alias(c) for c in ("version", "recorded", "uncertain", "excluded")])
