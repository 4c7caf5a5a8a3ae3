"""How far verdicts can be trusted: confusion, agreement, entropy, replacement tests, ablations, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlens.operators.sampling import KEY

PAIR = (*KEY, "label")


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("bigint"))


def _judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`pairs` (message, label) with `said`: whether the model applies the label; a label that its row lacks is not applied.

    A message that the model never labeled is an error. Verdicts are gathered by message, so one
    shuffle by message serves both.
    """
    model = verdicts.groupBy(*KEY).agg(F.collect_set(F.when(F.col("applies"), F.col("label"))).alias("__on"))
    missing = F.raise_error(F.concat(F.lit("no verdicts for message "), F.concat_ws(":", *KEY)))
    met = pairs.join(model, list(KEY), "left")
    return met.withColumn("said", F.when(F.col("__on").isNull(), missing).otherwise(F.array_contains("__on", F.col("label")))).drop("__on")


def confusion(audit: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per label tp, fp, fn, tn over the judged pairs, and the measures made from them; null where a denominator is 0.

    A label that the model's row for a message lacks counts as not applied; an audited message
    without any verdict is an error when the result is computed (`missing_verdicts` lists them).
    """
    c = _judged(audit, verdicts).groupBy("label").agg(
        _n(F.col("applies") & F.col("said")).alias("tp"), _n(~F.col("applies") & F.col("said")).alias("fp"),
        _n(F.col("applies") & ~F.col("said")).alias("fn"), _n(~F.col("applies") & ~F.col("said")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    c = c.withColumns({
        "support": tp + fn, "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp),
        "agreement": F.coalesce(F.try_divide(tp + tn, n), F.lit(0.0)),
    })
    # chance agreement is 1 exactly when both sides say one and the same thing throughout
    chance = (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)
    pe = chance / (n * n)
    kappa = F.when((n > 0) & (chance != n * n), (F.col("agreement") - pe) / (1 - pe))
    j = F.col("recall") + F.col("specificity") - 1
    corrected = F.when(j > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.try_divide(tp + fp, n) + F.col("specificity") - 1) / j)))
    return c.withColumn("kappa", kappa).withColumn("corrected_prevalence", corrected)


def missing_verdicts(audit: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Audited messages that the model never labeled; `confusion` fails on each of them."""
    return audit.select(*KEY).distinct().join(verdicts.select(*KEY).distinct(), list(KEY), "left_anti")


def validation_table(audit: DataFrame, verdicts: DataFrame, ceilings: DataFrame, floor: float = 0.2) -> DataFrame:
    """Confusion measures with the human ceiling and a flag for labels near chance, most support first."""
    c = confusion(audit, verdicts).join(ceilings.select("label", "ceiling"), "label", "left")
    return c.withColumn("near_chance", F.coalesce(F.col("kappa") < floor, F.lit(False))).orderBy(F.desc("support"), "label")


def human_ceilings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per label how often two annotators agree on the pairs that both judged."""
    both = a.join(b.select(*PAIR, F.col("applies").alias("other")), list(PAIR))
    return both.groupBy("label").agg((_n(F.col("applies") == F.col("other")) / F.count("*")).alias("ceiling"))


def outcome_anchors(verdicts: DataFrame, facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per (label, pattern) how often the label's positives lie in the pattern, against all messages; flagged below that baseline."""
    m = verdicts.join(facts.select(*KEY, "pre_pattern"), list(KEY), "left")
    every = m.select(*KEY, "pre_pattern").distinct().crossJoin(F.broadcast(anchors.select("expected_pattern").distinct()))
    base = every.groupBy("expected_pattern").agg((_n(F.coalesce(F.col("pre_pattern") == F.col("expected_pattern"), F.lit(False))) / F.count("*")).alias("baseline"))
    hit = anchors.join(m.filter("applies"), "label", "left").groupBy("label", "expected_pattern").agg(
        F.coalesce(_n(F.col("pre_pattern") == F.col("expected_pattern")), F.lit(0)).alias("in_pattern"), F.count("chatlog_id").alias("total_positives")
    )
    out = hit.join(base, "expected_pattern", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    out = out.withColumn("concentration", F.coalesce(F.try_divide("in_pattern", "total_positives"), F.lit(0.0)))
    return out.withColumn("flagged", (F.col("total_positives") > 0) & (F.col("concentration") < F.col("baseline")))


def vote_entropy(votes: DataFrame) -> DataFrame:
    """Per message the mean and the maximum over labels of the binary entropy of the share of yes votes."""
    by_label = votes.groupBy(*PAIR).agg(F.avg(F.col("applies").cast("double")).alias("p"))
    p = F.col("p")
    e = F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return by_label.withColumn("e", e).groupBy(*KEY).agg(F.avg("e").alias("mean_entropy"), F.max("e").alias("max_entropy"))


def alt_test(audits: DataFrame, verdicts: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """Per annotator how often the model agrees with the others at least as well as the annotator does, and whether the model wins.

    Items are messages; only labels that every annotator judged on a message count. Fewer than
    two annotators are an error when the result is computed. Matches are
    compared as whole numbers: both sides are summed over the same pairs, so no rounding decides.
    """
    who = audits.groupBy("annotator").count().agg(F.count("*").alias("__n"))
    few = F.raise_error(F.lit("an alternative-annotator test needs two annotators or more"))
    # dealt by message once: pairs, and the model's rows for the message, are met there
    human = audits.repartition(*KEY).groupBy(*PAIR).agg(F.collect_set(F.struct("annotator", "applies")).alias("all"))
    human = human.crossJoin(F.broadcast(who)).filter(F.when(F.col("__n") < 2, few).otherwise(F.size("all") == F.col("__n"))).drop("__n")
    # a message is an item if the model labeled it; a label it lacks there counts as not applied
    model = verdicts.groupBy(*KEY).agg(F.collect_set(F.when(F.col("applies"), F.col("label"))).alias("on"))
    met = human.join(model, list(KEY)).withColumn("said", F.array_contains("on", F.col("label"))).withColumn("own", F.explode("all"))
    others = F.filter("all", lambda x: x["annotator"] != F.col("own.annotator"))
    agree = lambda with_: F.size(F.filter(others, lambda x: x["applies"] == with_)).cast("bigint")
    per_item = met.groupBy(F.col("own.annotator").alias("annotator"), *KEY).agg(F.sum(agree(F.col("said"))).alias("model"), F.sum(agree(F.col("own.applies"))).alias("human"))
    out = per_item.groupBy("annotator").agg(F.count("*").alias("n_items"), (_n(F.col("model") >= F.col("human")) / F.count("*")).alias("advantage"))
    return out.withColumn("wins", F.col("advantage") >= 0.5 - epsilon)


def alt_test_passes(result: DataFrame) -> DataFrame:
    return result.agg((_n(F.col("wins")) * 2 > F.count("*")).alias("passes"), F.count("*").alias("annotators"))


def _flips(original: DataFrame, ablated: DataFrame) -> DataFrame:
    """(key, label, flipped) for the original labels of every ablated message; one that was not labeled before is an error."""
    before = original.groupBy(*KEY).agg(F.collect_set(F.struct("label", "applies")).alias("before"))
    after = ablated.groupBy(*KEY).agg(F.collect_set(F.when(F.col("applies"), F.col("label"))).alias("after"))
    missing = F.raise_error(F.concat(F.lit("no original verdicts for message "), F.concat_ws(":", *KEY)))
    met = after.join(before, list(KEY), "left").withColumn("before", F.when(F.col("before").isNull(), missing).otherwise(F.col("before")))
    each = met.select(*KEY, "after", F.explode("before").alias("b"))
    return each.select(*KEY, F.col("b.label").alias("label"), (F.array_contains("after", F.col("b.label")) != F.col("b.applies")).alias("flipped"))


def flip_stats(original: DataFrame, ablated: DataFrame) -> DataFrame:
    """Per label how many verdicts of the ablated messages differ from the original, of how many; a label that is gone counts as not applied."""
    return _flips(original, ablated).groupBy("label").agg(_n(F.col("flipped")).alias("flips"), F.count("*").alias("total"))


def messages_with_flips(original: DataFrame, ablated: DataFrame) -> DataFrame:
    m = _flips(original, ablated).groupBy(*KEY).agg(F.bool_or("flipped").alias("flipped"))
    return m.agg(F.count("*").alias("messages"), _n(F.col("flipped")).alias("messages_with_flips"))


def admitted(table: DataFrame, support: int = 25, share_of_ceiling: float = 0.8, kappa: float = 0.4) -> DataFrame:
    """Labels of a validation table that may be used: enough support, precision near the human ceiling, kappa, not near chance."""
    return table.filter((F.col("support") >= support) & (F.col("precision") >= share_of_ceiling * F.col("ceiling")) & (F.col("kappa") >= kappa) & ~F.col("near_chance"))
