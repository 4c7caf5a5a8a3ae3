"""Mergeable sketches for reports over time: distinct counts and quantiles of any span of weeks without reading messages again.

A week's sketches are a few kilobytes however many messages it has. They are stored once and
merged for each report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch, as a power of two, and the size of a quantile sketch.
LOG_K, QUANTILE_K = 12, 400
#: Errors: three standard deviations of a distinct count (1.04 / sqrt(2^LOG_K)), and of a quantile's rank.
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_K / 2), 0.02


def sketched(messages: DataFrame, *by: str) -> DataFrame:
    """(by, n, messages, conversations, waits) of rows (chatlog_id, message_index, latency_seconds and `by`): sketches as binaries.

    Nulls among the waits are left out; a group without waits has a null sketch of them.
    """
    key = F.concat_ws(":", "chatlog_id", "message_index")
    return messages.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(key, LOG_K).alias("messages"), F.hll_sketch_agg(F.col("chatlog_id").cast("bigint"), LOG_K).alias("conversations"),
        F.when(F.count("latency_seconds") > 0, F.kll_sketch_agg_double(F.col("latency_seconds").cast("double"), QUANTILE_K)).alias("waits"),
    )


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups from those of smaller ones; one of all rows without `by`."""
    waits = F.when(F.count("waits") > 0, F.kll_merge_agg_double("waits"))
    aggregates = [F.sum("n").alias("n"), F.hll_union_agg("messages").alias("messages"), F.hll_union_agg("conversations").alias("conversations"), waits.alias("waits")]
    return sketches.groupBy(*by).agg(*aggregates) if by else sketches.agg(*aggregates)


def estimates(sketches: DataFrame, *ranks: float) -> DataFrame:
    """The sketches' groups with estimates: n_messages, n_conversations, and `waits` at the given ranks (0 to 1), within COUNT_ERROR and RANK_ERROR."""
    keep = [c for c in sketches.columns if c not in ("messages", "conversations", "waits")]
    at = F.array(*[F.when(F.col("waits").isNotNull(), F.kll_sketch_get_quantile_double("waits", F.lit(float(r)))) for r in ranks]) if ranks else F.array().cast("array<double>")
    return sketches.select(*keep, F.hll_sketch_estimate("messages").alias("n_messages"), F.hll_sketch_estimate("conversations").alias("n_conversations"), at.alias("waits"))
