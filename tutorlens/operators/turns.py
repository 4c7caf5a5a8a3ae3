"""What a turn says about itself: context, latency, switches of mode, place and length of its conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.functions.text import latency_bucket
from tutorlens.params import Params
from tutorlens.sources.shared import settled


def _in_order() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn_index")


def with_context(turns: DataFrame, width: int = Params.window_turns) -> DataFrame:
    """`context`: up to `width` turns before, in order; `context_after`: the next tutor text, if any follows."""
    w = _in_order()
    before = F.collect_list(F.struct("turn_index", "role", "text")).over(w.rowsBetween(-width, -1))
    after = F.first(F.when(F.col("role") == "tutor", F.col("text")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return turns.withColumn("context", before).withColumn("context_after", after)


def with_latency(turns: DataFrame, params: Params = Params()) -> DataFrame:
    """`latency_seconds` since the nearest tutor turn before, and its class.

    The nearest tutor turn counts even where its time is missing; then the wait is unknown.
    """
    w = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    tutor = F.last(F.when(F.col("role") == "tutor", F.struct("us")), ignorenulls=True).over(w)
    t = turns.withColumn("__tutor", tutor).withColumn("latency_seconds", (F.col("us") - F.col("__tutor.us")) / 1e6)
    bucket = latency_bucket(F.col("latency_seconds"), F.col("__tutor").isNull(), params.rapid_seconds, params.working_seconds, params.delayed_seconds)
    return t.withColumn("latency_bucket", bucket).drop("__tutor")


def with_defection(turns: DataFrame) -> DataFrame:
    """`defected`: a student turn in chatgpt mode whose last known mode before was tutor. Every such switch counts."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.nullif("mode", F.lit("")), ignorenulls=True).over(w)
    return turns.withColumn("defected", F.coalesce((F.col("role") == "student") & (F.col("mode") == "chatgpt") & (before == "tutor"), F.lit(False)))


def length_terciles(turns: DataFrame) -> DataFrame:
    """(conv_id, n_student, tercile): conversations ranked by student turns, then id, in thirds; the last third takes the rest.

    Conversations are sorted across tasks by ranges, however many have one length; a row's rank
    is its place in its range behind the counts of the ranges before, which alone come together.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.when(F.col("role") == "student", 1)).alias("n_student"))
    ranged = settled(sizes.repartitionByRange("n_student", "conv_id").sortWithinPartitions("n_student", "conv_id").withColumn("__id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = ranged.groupBy("__range").agg(F.count("*").alias("k"))
    before = before.select("__range", (F.sum("k").over(Window.orderBy("__range")) - F.col("k")).alias("first"), F.sum("k").over(Window.partitionBy()).alias("total"))
    ranked = ranged.join(F.broadcast(before), "__range").withColumn("rank", F.col("first") + F.col("__place"))
    third = F.least(F.floor(F.col("rank") / F.greatest(F.lit(1), F.floor(F.col("total") / 3))), F.lit(2))
    return ranked.select("conv_id", "n_student", F.when(third == 0, "short").when(third == 1, "mid").otherwise("long").alias("tercile"))


def with_position(turns: DataFrame, terciles: DataFrame) -> DataFrame:
    """`tercile` and `position`: early while the student index is below half of the student turns."""
    t = turns.join(terciles, "conv_id")
    return t.withColumn("position", F.when(F.col("student_index") < F.col("n_student") / 2.0, "early").otherwise("late"))


def conversation_weeks(heads: DataFrame) -> DataFrame:
    """`week`: whole weeks since the first start of all; null where a start is missing."""
    earliest = heads.agg(F.min("started_us").alias("__first"))
    days = F.floor((F.col("started_us") - F.col("__first")) / 86_400_000_000)
    return heads.crossJoin(F.broadcast(earliest)).withColumn("week", F.floor(days / 7).cast("bigint")).drop("__first")
