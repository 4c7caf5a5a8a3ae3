"""Prevalence, trends, co-occurrence and coverage of labels, from a long table of verdicts.

`verdicts` has one row per message and label (chatlog_id, message_index, label, label_ord,
applies, no_label_fits). A pair without a row was not judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.operators.sampling import KEY
from tutorlens.params import MODES


def _per_message(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*KEY).agg(F.sum(F.col("applies").cast("bigint")).alias("n_labels"), F.bool_or("no_label_fits").alias("abstained"))


def totals(verdicts: DataFrame) -> DataFrame:
    """Messages, conversations, messages with a label, and labels for each of these.

    Dealt by conversation once: messages and conversations are both counted there.
    """
    m = _per_message(verdicts.repartition("chatlog_id"))
    c = m.groupBy("chatlog_id").agg(F.count("*").alias("messages"), F.count(F.when(F.col("n_labels") > 0, 1)).alias("with_label"), F.sum("n_labels").alias("n_labels"))
    with_label = F.coalesce(F.sum("with_label"), F.lit(0))
    return c.agg(
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.count("chatlog_id").alias("conversations"), with_label.alias("with_label"),
        F.coalesce(F.bround(F.try_divide(F.sum("n_labels"), with_label), 1), F.lit(0.0)).cast("double").alias("labels_per_labeled"),
    )


def prevalence(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Count and share of every label, also of those without a verdict."""
    n = verdicts.agg(F.countDistinct(*KEY).alias("n_messages"))
    counts = verdicts.filter("applies").groupBy("label").agg(F.count("*").alias("n"))
    out = labels.select("label_ord", "label").join(counts, "label", "left").crossJoin(F.broadcast(n))
    return out.select("label_ord", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), "n_messages"), F.lit(0.0)).alias("share"))


def weekly(verdicts: DataFrame, weeks: DataFrame, least_weeks: int = 3) -> DataFrame:
    """(week, label, label_ord, share): of the messages of each week; empty with fewer populated weeks or with fewer than two labels in use.

    Verdicts are read once: gathered by message, then counted by week and label, with one more
    row for each message itself. What follows has a row for each week and label.
    """
    own = verdicts.groupBy(*KEY).agg(F.collect_list(F.struct("label", "label_ord", "applies")).alias("v"))
    dated = own.join(weeks.select("chatlog_id", "week"), "chatlog_id", "left")
    itself = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("label_ord"), F.lit(False).alias("applies")))
    each = dated.select("week", F.explode(F.concat(itself, F.col("v").cast("array<struct<label:string,label_ord:int,applies:boolean>>"))).alias("v")).select("week", "v.*")
    n = each.groupBy("week", "label", "label_ord").agg(F.sum(F.col("applies").cast("bigint")).alias("n"), F.count("*").alias("k"))
    in_week = F.max(F.when(F.col("label").isNull(), F.col("k"))).over(Window.partitionBy("week"))
    every = Window.partitionBy()  # weeks times labels
    n = n.withColumn("n_week", in_week).withColumn("used", F.size(F.collect_set(F.when(F.col("n") > 0, F.col("label"))).over(every)))
    n = n.withColumn("n_weeks", F.count(F.when(F.col("label").isNull() & F.col("week").isNotNull(), 1)).over(every))
    out = n.filter(F.col("week").isNotNull() & F.col("label").isNotNull() & (F.col("n_weeks") >= least_weeks) & (F.col("used") >= 2))
    return out.select("week", "label", "label_ord", (F.col("n") / F.col("n_week")).alias("share"))


def undated(heads: DataFrame) -> DataFrame:
    return heads.agg(F.count(F.when(F.col("started_us").isNull(), 1)).alias("undated"))


def largest_jump(shares: DataFrame) -> DataFrame:
    """The largest change between adjacent weeks; the first label and week win ties; a gap between weeks is no change."""
    w = Window.partitionBy("label").orderBy("week")
    s = shares.withColumn("before", F.lag("share").over(w)).withColumn("gap", F.col("week") - F.lag("week").over(w))
    s = s.filter("gap = 1").withColumn("delta", F.col("share") - F.col("before"))
    return s.orderBy(F.desc(F.abs("delta")), "label_ord", "week").limit(1).select("label", "week", F.bround("delta", 4).alias("delta"))


def pairs(verdicts: DataFrame) -> DataFrame:
    """(a, b, n_both): labels a < b of one message."""
    on = verdicts.filter("applies").select(*KEY, "label", "rationale")
    x = on.select(*KEY, F.col("label").alias("a"), F.col("rationale").alias("ra"))
    y = on.select(*KEY, F.col("label").alias("b"), F.col("rationale").alias("rb"))
    return x.join(y, list(KEY)).filter("a < b")


def top_pairs(verdicts: DataFrame, n: int = 3) -> DataFrame:
    total = verdicts.agg(F.countDistinct(*KEY).alias("n_messages"))
    both = pairs(verdicts).groupBy("a", "b").agg(F.count("*").alias("n_both"))
    return both.crossJoin(F.broadcast(total)).select("a", "b", "n_both", (F.col("n_both") / F.col("n_messages")).alias("share")).orderBy(F.desc("n_both"), "a", "b").limit(n)


def coverage_histogram(verdicts: DataFrame, heads: DataFrame) -> DataFrame:
    """(bin, n): conversations by their labeled messages, 15 and more together; all 16 bins."""
    labeled = _per_message(verdicts).filter("n_labels > 0").groupBy("chatlog_id").agg(F.count("*").alias("k"))
    n = heads.join(labeled, "chatlog_id", "left").groupBy(F.least(F.coalesce("k", F.lit(0)), F.lit(15)).alias("bin")).agg(F.count("*").alias("n"))
    bins = heads.sparkSession.range(16).select(F.col("id").alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def abstention(verdicts: DataFrame) -> DataFrame:
    m = _per_message(verdicts)
    return m.agg(F.sum(F.col("abstained").cast("bigint")).alias("abstained"), F.count("*").alias("messages")).withColumn("rate", F.try_divide("abstained", "messages"))


def zero_examples(verdicts: DataFrame, heads: DataFrame, firsts: DataFrame, n: int, seed: int) -> DataFrame:
    """Up to n conversations without any label, at random, with their first student turn."""
    labeled = verdicts.filter("applies").select("chatlog_id").distinct()
    order = F.md5(F.concat_ws(":", F.lit(seed), "chatlog_id"))
    return heads.join(labeled, "chatlog_id", "left_anti").orderBy(order, "chatlog_id").limit(n).join(firsts, "chatlog_id").select("chatlog_id", "text")


def label_overlap(verdicts: DataFrame, least: float = 0.4) -> DataFrame:
    """(a, b, jaccard, n_both, rationale_overlap) for pairs of labels at or above `least`."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    p = pairs(verdicts).withColumn("wa", words("ra")).withColumn("wb", words("rb"))
    sim = F.size(F.array_intersect("wa", "wb")) / F.greatest(F.lit(1), F.size(F.array_union("wa", "wb")))
    both = p.groupBy("a", "b").agg(F.count("*").alias("n_both"), F.avg(sim).alias("rationale_overlap"))
    each = verdicts.filter("applies").groupBy("label").agg(F.count("*").alias("n"))
    x, y = each.select(F.col("label").alias("a"), F.col("n").alias("na")), each.select(F.col("label").alias("b"), F.col("n").alias("nb"))
    out = both.join(F.broadcast(x), "a").join(F.broadcast(y), "b").withColumn("jaccard", F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both")))
    return out.filter(F.col("jaccard") >= least).select("a", "b", "jaccard", "n_both", "rationale_overlap")


def mode_split(verdicts: DataFrame) -> DataFrame:
    """Positives of each label by mode of the message; no mode is 'unknown', any mode besides the known ones 'other'."""
    mode = F.coalesce(F.nullif("mode", F.lit("")), F.lit("unknown"))
    known = F.when(mode.isin(*MODES), mode).otherwise("other")
    return verdicts.filter("applies").withColumn("m", known).groupBy("label").pivot("m", [*MODES, "other"]).agg(F.count(F.lit(1))).na.fill(0)
