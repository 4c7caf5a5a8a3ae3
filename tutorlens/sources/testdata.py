"""Canonical tables from the driver's synthetic ones, by fixed expressions.

`events` becomes a tutor log: its type names the kind of event, a user's day is a conversation,
and the number k of its props stands for the payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.sources.events import assemble_turns

DAY = 86_400_000_000
KINDS = {"view": "tutor_query", "click": "tutor_response", "signup": "tutor_notebook_info", "error": "autograder_info", "purchase": "autograder_info"}
#: Label and the k that it applies to: k divisible by the number.
LABELS = {"confused": 2, "debugging": 3, "frustrated": 4, "planning": 8}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = read(spark, sf_dir, "events").select("event_id", us.alias("us"), "user_id", "event_type", k.alias("k"))
    q, s = F.lit("q"), F.lit("_")
    asked = (
        F.when(F.col("k") % 10 == 9, F.lit(""))
        .when(F.col("k") % 4 == 0, F.concat(q, F.col("k") % 7, s, F.col("k") % 3, F.lit(" keeps failing")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("stuck on question "), F.col("k") % 7, F.lit("."), F.col("k") % 3))
        .otherwise(F.concat(F.lit("my groupby is broken "), F.col("k")))
    )
    return e.select(
        "event_id", "us", F.col("user_id").alias("user_key"), kind[F.col("event_type")].alias("event_type"),
        F.concat("user_id", F.lit("-"), F.expr(f"us div {DAY}")).alias("conv_id"),
        F.concat(F.lit("nb"), F.col("user_id") % 5).alias("notebook"),
        F.when(F.col("event_type") == "view", asked).alias("question"),
        F.when(F.col("event_type") == "click", F.when(F.col("k") % 10 == 8, "").otherwise(F.concat(F.lit("reply "), "event_id"))).alias("response"),
        F.when(F.col("k") % 5 == 0, "chatgpt").when(F.col("k") % 5 == 1, "").otherwise("tutor").alias("mode"),
        F.when(F.col("event_type").isin("error", "purchase"), F.concat(q, F.col("k") % 7, s, F.col("k") % 3)).alias("grader_id"),
        F.when(F.col("event_type") == "error", "false").when(F.col("event_type") == "purchase", "true").alias("success"),
        F.when(F.col("event_type") == "signup", F.when(F.col("k") % 3 == 0, "Traceback (most recent call last)").otherwise("ok")).alias("notebook_json"),
        "k",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student turns of the log with their k: the messages that labels are about."""
    turns = assemble_turns(log(spark, sf_dir), extra=("k",)).filter("role = 'student'")
    return turns.select("chatlog_id", F.col("turn_index").alias("message_index"), "conv_id", "text", "mode", "us", "k")


def abstains() -> F.Column:
    """Whether no label fits a message, by its k."""
    return (F.col("k") % 2 != 0) & (F.col("k") % 3 != 0) & (F.col("k") % 5 == 0)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, d) for i, (name, d) in enumerate(LABELS.items())], "label_ord int, label string, divisor int")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message and label: applies, rationale, and whether the message abstained."""
    m = messages(spark, sf_dir).crossJoin(F.broadcast(labels(spark)))
    applies = F.col("k") % F.col("divisor") == 0
    none = abstains()
    said = F.concat(F.col("label"), F.lit(" because the student wrote "), F.col("text"))
    return m.select("chatlog_id", "message_index", "conv_id", "mode", "us", "k", "label", "label_ord", applies.alias("applies"), F.when(applies, said).otherwise("").alias("rationale"), none.alias("no_label_fits"))


def flips(seed: str | F.Column, one_in: int | F.Column) -> F.Column:
    """A fixed coin for each (message, label)."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    first = F.conv(F.substring(F.md5(F.concat_ws(":", seed, "chatlog_id", "message_index", "label")), 1, 6), 16, 10).cast("bigint")
    return first % one_in == 0


def audits(spark: SparkSession, sf_dir: str, *annotators: int) -> DataFrame:
    """Blind judgments of these humans: each judges about two thirds of the pairs, one in 6 + annotator against the model."""
    v = verdicts(spark, sf_dir).withColumn("annotator", F.explode(F.array(*[F.lit(a) for a in annotators])))
    who = F.col("annotator")
    judged = v.filter(~flips(F.concat(F.lit("judged"), who), 3))
    return judged.select("annotator", "chatlog_id", "message_index", "label", (F.col("applies") != flips(F.concat(F.lit("human"), who), who + 6)).alias("applies"))


def audit(spark: SparkSession, sf_dir: str, annotator: int) -> DataFrame:
    return audits(spark, sf_dir, annotator)


def votes(spark: SparkSession, sf_dir: str, runs: int = 5) -> DataFrame:
    """Repeated verdicts of one model: run r turns one verdict in 5 + r."""
    v = verdicts(spark, sf_dir).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    said = F.col("applies") != flips(F.concat(F.lit("vote"), F.col("run")), F.col("run") + 5)
    return v.select("run", "chatlog_id", "message_index", "label", said.alias("applies"))
