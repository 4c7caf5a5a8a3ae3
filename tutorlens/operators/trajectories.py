"""Trajectories of conversations: transition vectors, and archetypes that they group around.

A conversation is a sequence of states. Its vector holds, for each pair of states, the share of
its transitions that lead from the one to the other, in whole ten-thousandths. Vectors are
grouped around k centres (k-means over distinct vectors with their numbers of conversations).
Shares, centres and distances are whole numbers and ties go to the smaller one, so centres and
members are the same at any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.sources.shared import settled

#: What a vector's entries add up to, about, and rounds of moving centres at most.
UNIT, ROUNDS = 10_000, 50


def transitions(states: DataFrame) -> DataFrame:
    """(conv_id, state, next_state, n) of rows (conv_id, turn_index, state): how often a conversation goes from one state to the next.

    A null state is none: its neighbours on both sides are not joined by it. A conversation of one
    message has no transitions.
    """
    following = F.lead("state").over(Window.partitionBy("conv_id").orderBy("turn_index"))
    steps = states.select("conv_id", "state", following.alias("next_state")).filter("state IS NOT NULL AND next_state IS NOT NULL")
    return steps.groupBy("conv_id", "state", "next_state").agg(F.count("*").alias("n"))


def vectors(steps: DataFrame, names: Sequence[str]) -> DataFrame:
    """(conv_id, n, v) from `transitions`: the number of transitions, and their shares for all pairs of `names`, row by row.

    A conversation with states other than `names` has a share for the named pairs only; one
    without named pairs has no vector.
    """
    place = F.create_map(*[F.lit(x) for i, (a, b) in enumerate((a, b) for a in names for b in names) for x in (f"{a}\x1f{b}", i)])
    at = place[F.concat("state", F.lit("\x1f"), "next_state")]
    own = steps.withColumn("at", at).groupBy("conv_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.when(at.isNotNull(), F.struct("at", "n")))).alias("by"))
    share = lambda i: F.coalesce(F.floor((F.col("by")[i] * 2 * UNIT + F.col("n")) / (2 * F.col("n"))), F.lit(0)).cast("bigint")
    return own.filter(F.size("by") > 0).select("conv_id", "n", F.transform(F.sequence(F.lit(0), F.lit(len(names) ** 2 - 1)), share).alias("v"))


def _distance(v: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(v, centre, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, d: s + d)


def _centre(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(x)).cast("bigint") for x in values])


def _placed(points: DataFrame, centres: Sequence[Sequence[int]]) -> DataFrame:
    """`points` with the nearest centre (the smallest number of equally near ones) and the squared distance to it."""
    far = F.array(*[_distance(F.col("v"), _centre(c)) for c in centres])
    return points.withColumn("far", far).withColumn("distance", F.array_min("far")).withColumn("archetype", (F.array_position("far", F.col("distance")) - 1).cast("int")).drop("far")


def centres(points: DataFrame, k: int) -> list[list[int]]:
    """k centres, or as many as there are distinct vectors, from rows (v, weight) of distinct vectors.

    The first is the vector of most conversations; each next one is that with the largest product
    of weight and squared distance to the nearest so far. Then centres move to the rounded mean of
    their members until none moves. The driver sees k vectors a round.
    """
    first = points.orderBy(F.desc("weight"), "v").limit(1).collect()
    out = [list(r["v"]) for r in first]
    while out and len(out) < k:
        farthest = _placed(points, out).filter("distance > 0").orderBy(F.desc(F.col("weight") * F.col("distance").cast("decimal(38,0)")), "v").limit(1).collect()
        if not farthest:
            break
        out.append(list(farthest[0]["v"]))
    for _ in range(ROUNDS if out else 0):
        sums = _placed(points, out).select("archetype", "weight", F.posexplode("v").alias("at", "x")).groupBy("archetype", "at")
        rows = sums.agg(F.sum(F.col("x") * F.col("weight")).alias("s"), F.sum("weight").alias("n")).collect()  # k vectors
        moved = [list(c) for c in out]  # a centre without members stays
        for r in rows:
            moved[r["archetype"]][r["at"]] = (2 * r["s"] + r["n"]) // (2 * r["n"])
        if moved == out:
            break
        out = moved
    return out


def archetypes(steps: DataFrame, names: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(members, centres): (conv_id, archetype, distance), and (archetype, n, example, state, next_state, share), a row for each pair of states.

    `example` is the conversation that lies nearest to its centre, the smallest id of several. Archetypes
    are numbered by their conversations, most first. Conversations without named transitions are in none.
    """
    own = settled(vectors(steps, names))
    points = settled(own.groupBy("v").agg(F.count("*").alias("weight")))
    found = centres(points, k)
    spark = steps.sparkSession
    if not found:
        return spark.createDataFrame([], "conv_id string, archetype int, distance bigint"), spark.createDataFrame([], "archetype int, n bigint, example string, state string, next_state string, share double")
    placed = _placed(own, found)
    sizes = {r["archetype"]: r for r in placed.groupBy("archetype").agg(F.count("*").alias("n"), F.min(F.struct("distance", "conv_id")).alias("x")).collect()}  # k rows
    order = {a: i for i, a in enumerate(sorted(sizes, key=lambda a: (-sizes[a]["n"], found[a])))}
    number = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    pairs = [(a, b) for a in names for b in names]
    rows = [(order[a], r["n"], r["x"]["conv_id"], *pairs[i], found[a][i] / UNIT) for a, r in sizes.items() for i in range(len(pairs))]
    table = spark.createDataFrame(rows, "archetype int, n bigint, example string, state string, next_state string, share double")
    return placed.select("conv_id", number[F.col("archetype")].alias("archetype"), "distance"), table
