"""Study sessions: a student's events with no gap longer than a bound, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def study_sessions(log: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """(user_key, started_us, ended_us, n_events, n_messages, n_runs, n_passed) of each session.

    A gap longer than `gap` parts two sessions. With `delay`, for a stream, a session is given out
    once the watermark has passed its end and the gap; rows later than `delay` are left out, and
    `late_rows` counts them. Rows without a user or a time are in no session.
    """
    rows = log.filter(F.col("user_key").isNotNull() & F.col("us").isNotNull()).withColumn("at", F.timestamp_micros("us"))
    rows = rows if delay is None else rows.withWatermark("at", delay)
    kind = F.col("event_type")
    found = rows.groupBy("user_key", F.session_window("at", gap).alias("w")).agg(
        F.min("us").alias("started_us"), F.max("us").alias("ended_us"), F.count("*").alias("n_events"), F.count(F.when(kind == "tutor_query", 1)).alias("n_messages"),
        F.count(F.when(kind == "autograder_info", 1)).alias("n_runs"), F.count(F.when((kind == "autograder_info") & (F.col("success") == "true"), 1)).alias("n_passed"),
    )
    return found.drop("w")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream's stateful operators have left out because they came behind the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
