"""Deterministic samples: an order by hash, so results depend on seed and keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.sources.shared import settled

KEY = ("chatlog_id", "message_index")


def drawn(seed: str | int | Column, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), *keys))


def round_robin(rows: DataFrame, n: int | None, seed: int, stratum: str = "stratum", keys: Sequence[str] = KEY) -> DataFrame:
    """One of each stratum in turn, in the order of strata, until there are n; all rows without n."""
    if n is None:
        return rows
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(drawn(seed, *keys), *keys))
    # of a stratum no more than n rows can be taken
    return rows.withColumn("__rn", rn).filter(F.col("__rn") <= n).orderBy("__rn", stratum).limit(n).drop("__rn")


def excluded(pool: DataFrame, *keys: DataFrame) -> DataFrame:
    """`pool` without the messages in any of the key tables."""
    for k in keys:
        pool = pool.join(k.select(*KEY).distinct(), list(KEY), "left_anti")
    return pool


def audit_sample(pool: DataFrame, entropies: DataFrame | None, n: int, seed: int, abstained_share: float = 0.4) -> DataFrame:
    """(key, audit_stratum) for n messages: abstained ones first, then uncertain ones, then a random fill.

    `pool` has no_label_fits; `entropies` has max_entropy. Abstained messages take
    max(1, floor(n * share)) places at most, and n at most; messages with positive entropy are
    taken by entropy until 0.8 n places are filled; the rest is drawn at random. Every stage
    keeps its first n rows only, so what is ranked together is 3 n rows. Pool and entropies are
    put together once, in the shared checkpoint folder, and read by all stages.
    """
    pool = pool.select(*KEY, "no_label_fits").distinct()
    if entropies is not None:
        pool = settled(pool.join(entropies.select(*KEY, "max_entropy"), list(KEY), "left"))
    order = [drawn(seed, *KEY), *[F.col(k) for k in KEY]]
    quota = min(n, max(1, int(n * abstained_share)))
    first = pool.filter("no_label_fits").orderBy(*order).limit(quota).select(*KEY, F.lit("abstained").alias("audit_stratum"))
    rest = pool.join(F.broadcast(first.select(*KEY)), list(KEY), "left_anti")
    taken = first
    if entropies is not None:
        used = first.agg(F.count("*").alias("used"))
        ranked = rest.filter("max_entropy > 0").select(*KEY, "max_entropy").orderBy(F.desc("max_entropy"), *KEY).limit(n)
        ranked = ranked.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("max_entropy"), *KEY))).crossJoin(F.broadcast(used))
        # one more is taken as long as fewer than 0.8 n places are filled
        second = ranked.filter(F.col("used") + F.col("rn") - 1 < F.lit(n * 0.8)).select(*KEY, F.lit("high-entropy").alias("audit_stratum"))
        taken = first.unionByName(second)
        rest = rest.join(F.broadcast(second.select(*KEY)), list(KEY), "left_anti")
    used = taken.agg(F.count("*").alias("used"))
    fill = rest.select(*KEY).orderBy(*order).limit(n).withColumn("rn", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(used))
    return taken.unionByName(fill.filter(F.col("used") + F.col("rn") <= n).select(*KEY, F.lit("random").alias("audit_stratum")))


def label_audit_samples(pool: DataFrame, n: int, seed: int, positive_share: float = 0.5) -> DataFrame:
    """(label, key, audit_stratum, place): per label a share of positives, then abstained negatives, then other negatives.

    `pool` has one row per message and label with applies and no_label_fits. The places are
    shuffled, so that order tells an annotator nothing.
    """
    if not 0 < positive_share < 1:
        raise ValueError(f"positive_share must lie between 0 and 1, got {positive_share}")
    kind = F.when(F.col("applies"), "model-positive").when(F.col("no_label_fits"), "abstained-negative").otherwise("random-negative")
    rank = F.when(F.col("applies"), 0).when(F.col("no_label_fits"), 1).otherwise(2)
    seeded = F.concat(F.lit(f"{seed}:"), F.col("label"))
    p = pool.withColumn("audit_stratum", kind).withColumn("rank", rank).withColumn("h", drawn(seeded, *KEY))
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy("label", "rank").orderBy("h", *KEY)))
    quota = max(1, int(n * positive_share))
    # a plain bound first, which limits what each task keeps before the shuffle
    p = p.filter(F.col("rn") <= max(quota, n)).filter((F.col("rank") > 0) | (F.col("rn") <= quota))
    p = p.withColumn("all", F.row_number().over(Window.partitionBy("label").orderBy("rank", "rn"))).filter((F.col("rank") == 0) | (F.col("all") <= n))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat_ws(":", F.lit("place"), "h")), *KEY))
    return p.select("label", *KEY, "audit_stratum", place.alias("place"))


def example_sample(positives: DataFrame, lookup: DataFrame, n: int, seed: int) -> DataFrame:
    """n positives of a label at random, then joined to their texts; one without a text is lost, not replaced."""
    return positives.orderBy(drawn(seed, *KEY), *KEY).limit(n).join(lookup, list(KEY))


def most_uncertain(entropies: DataFrame, n: int, by: str = "max_entropy") -> DataFrame:
    return entropies.orderBy(F.desc(by), *KEY).limit(n)


def recent(rows: DataFrame, n: int = 3) -> DataFrame:
    return rows.orderBy(F.desc("us"), *KEY).limit(n)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they first appear."""
    return rows.groupBy(key).agg(F.min(order).alias(order))
