"""Blind audits: what an annotator sees, the answers file, and what is revealed after it is there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.operators.sampling import KEY


#: Messages that one annotator judges at most.
MOST_ANSWERS = 20_000


class NotSubmitted(RuntimeError):
    """Verdicts are shown only when the annotator's answers are final."""


def payload(sample: DataFrame, messages: DataFrame) -> DataFrame:
    """(key, text) of the sampled messages: no verdict, no stratum, no rationale."""
    return sample.select(*KEY).distinct().join(messages.select(*KEY, "text"), list(KEY))


def _answers(spark: SparkSession, folder: str, annotator: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder, f"human-labels-{annotator}.json")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def submit(spark: SparkSession, answers: DataFrame, folder: str, annotator: str) -> str:
    """Writes the judged pairs (key, label, applies) as the annotator's final file, once, and returns its path.

    An audit has as many messages as one person judges, MOST_ANSWERS at most, so they are written by the driver.
    """
    fs, at = _answers(spark, folder, annotator)
    rows = answers.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("label", "applies"))).alias("labels")).limit(MOST_ANSWERS + 1).collect()
    if len(rows) > MOST_ANSWERS:
        raise ValueError(f"one annotator's answers are for more than {MOST_ANSWERS} messages")
    said = [{"chatlog_id": r["chatlog_id"], "message_index": r["message_index"], "labels": dict(r["labels"])} for r in sorted(rows, key=lambda r: (r["chatlog_id"], r["message_index"]))]
    out = fs.create(at, False)  # a second submission fails
    out.write(bytearray(json.dumps({"rows": said, "strata": {}}, sort_keys=True).encode()))
    out.close()
    return at.toString()


def reveal(spark: SparkSession, sample: DataFrame, verdicts: DataFrame, folder: str, annotator: str) -> DataFrame:
    """(key, applied, no_label_fits) of the sampled messages, `applied` with rationales, after the annotator's submission only."""
    fs, at = _answers(spark, folder, annotator)
    if not fs.exists(at):
        raise NotSubmitted(f"{annotator} has not submitted")
    return revealed(sample, verdicts)


def revealed(sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    on = F.array_sort(F.collect_list(F.when(F.col("applies"), F.struct("label", "rationale"))))
    said = verdicts.join(F.broadcast(sample.select(*KEY).distinct()), list(KEY), "left_semi").groupBy(*KEY)
    return said.agg(on.alias("applied"), F.bool_or("no_label_fits").alias("no_label_fits"))
