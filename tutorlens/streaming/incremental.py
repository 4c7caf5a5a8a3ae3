"""Incremental labeling as a stream: an extension beyond the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tutorlens.operators.labeling import Progress, label_messages
from tutorlens.operators.verdicts import Provider, offline


def label_stream(
    spark: SparkSession, messages: DataFrame, labels: DataFrame, target: str, checkpoint: str, schema_version: str, provider: Provider = offline, on_progress: Progress | None = None,
) -> StreamingQuery:
    """A row of verdicts for each message of a stream, appended to `target` once; ends when the source is drained.

    Every micro-batch is one incremental run: what `target` holds is asked for no more, however
    late a message comes again and whatever its time, and no first-seen message is lost. So no
    state grows with the stream, and a batch that is replayed after a failure adds nothing twice.
    """

    def take(batch: DataFrame, _: int) -> None:
        label_messages(batch.sparkSession, batch, labels, target, schema_version, provider, on_progress=on_progress)

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
