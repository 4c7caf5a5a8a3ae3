"""The event log: parsing, conversation heads, turns, counts.

A log has one row per event: event_id, us (the time in microseconds), user_key, event_type, and
the payload's keys as columns (conv_id, notebook, question, response, mode, grader_id, success,
notebook_json). Times are integers, so results do not depend on a session's time zone.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAYLOAD = "conversation_id string, notebook string, question string, response string, mode string, grader_id string, success string, initial_notebook_json string"
TALK = ("tutor_query", "tutor_response")


def read_jdbc(spark: SparkSession, url: str | None = None, table: str = "events", kinds: Sequence[str] = (), partition_column: str = "id", bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """The raw table over JDBC, read in `partitions` ranges of `partition_column` between `bounds`.

    Without `url`, the environment's EVENTS_JDBC_URL is taken. `kinds` of events are filtered, and
    columns picked, by the database. Without `bounds`, they are asked for: one row.
    """
    at = url or os.environ.get("EVENTS_JDBC_URL")
    if not at:
        raise ValueError("give a url or set EVENTS_JDBC_URL")
    read = lambda: spark.read.format("jdbc").options(url=at, **options)
    if bounds is None:
        least = read().option("query", f"SELECT min({partition_column}) AS low, max({partition_column}) AS high FROM {table}").load().collect()[0]
        bounds = (int(least[0] or 0), int(least[1] or 0) + 1)
    raw = read().options(dbtable=table, partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)).load()
    return raw.filter(F.col("event_type").isin(*kinds)) if kinds else raw


def parse(raw: DataFrame) -> DataFrame:
    """A log from raw rows (id, event_type, created_at, user_email, payload); the payload is parsed once for all keys."""
    p = F.from_json("payload", PAYLOAD)
    return raw.select(F.col("id").alias("event_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"), F.col("user_email").alias("user_key"), "event_type", p.alias("p")).select(
        "event_id", "us", "user_key", "event_type", F.col("p.conversation_id").alias("conv_id"), "p.notebook", "p.question", "p.response", "p.mode", "p.grader_id", "p.success", F.col("p.initial_notebook_json").alias("notebook_json")
    )


def heads(log: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """One row per conversation: chatlog_id (its first event), notebook, started_us. Events without a conversation form one head.

    `since` and `until`, both or neither, bound the start of a conversation: from since on, before until.
    """
    if (since is None) != (until is None):
        raise ValueError("give both since and until, or neither")
    out = log.filter(F.col("event_type").isin(*TALK)).groupBy("conv_id").agg(F.min("event_id").alias("chatlog_id"), F.max("notebook").alias("notebook"), F.min("us").alias("started_us"))
    return out if since is None else out.filter((F.col("started_us") >= since) & (F.col("started_us") < until))


def first_heads(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy("chatlog_id").limit(n)


def sampled_heads(found: DataFrame, n: int, seed: int) -> DataFrame:
    """A uniform sample of n heads, in the order of chatlog_id; the same at any partitioning."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "chatlog_id"))
    return found.orderBy(drawn, "chatlog_id").limit(n).orderBy("chatlog_id")


def conversation_count(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event_type").isin(*TALK)).agg(F.countDistinct("conv_id").alias("n_conversations"))


def assemble_turns(log: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Turns in order: queries with text, and responses with text after the first such query.

    Columns: conv_id, chatlog_id, turn_index and student_index (from 0; null for the tutor), role,
    text, us, mode (of students only), event_id and every column of `log` named in `extra`.
    """
    talk = log.filter(F.col("event_type").isin(*TALK) & F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy("event_id")
    asked = (F.col("event_type") == "tutor_query") & (F.coalesce("question", F.lit("")) != "")
    started = F.max(F.col("asked").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    told = (F.col("event_type") == "tutor_response") & (F.coalesce("response", F.lit("")) != "")
    w = talk.withColumn("asked", asked).withColumn("chatlog_id", F.min("event_id").over(Window.partitionBy("conv_id")))
    w = w.withColumn("started", started).filter(F.col("asked") | (told & F.col("started")))
    role = F.when(F.col("asked"), "student").otherwise("tutor")
    before = F.count(F.when(F.col("asked"), 1)).over(order)
    return w.select(
        "conv_id", "chatlog_id", (F.row_number().over(order) - 1).alias("turn_index"), role.alias("role"),
        F.when(F.col("asked"), F.col("question")).otherwise(F.col("response")).alias("text"),
        F.when(F.col("asked"), before - 1).cast("int").alias("student_index"),
        "us", F.when(F.col("asked"), F.coalesce("mode", F.lit(""))).otherwise("").alias("mode"), "event_id", "user_key", "notebook", *extra,
    )


def fetch(log: DataFrame, limit: int | None = None, since: int | None = None, until: int | None = None, sample_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(heads, turns) of the conversations asked for; those without turns are dropped after the limit has counted them."""
    found = heads(log, since, until)
    if limit is not None:
        found = first_heads(found, limit) if sample_seed is None else sampled_heads(found, limit, sample_seed)
    turns = assemble_turns(log).join(found.select("conv_id"), "conv_id", "left_semi")
    return found.join(turns.select("conv_id"), "conv_id", "left_semi"), turns
