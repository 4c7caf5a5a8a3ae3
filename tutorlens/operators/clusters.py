"""Clusters of messages that say alike: what messages without a fitting label have in common.

A message's text is its set of words. Sets get min-hash signatures in bands; texts with an equal
band are a bucket, and a bucket is dense if it has `least` messages. In a dense bucket every text
is compared with the smallest one, exactly, and those that overlap enough are linked; clusters
are the connected components with `least` messages. So a bucket costs as many comparisons as it
has texts, equal texts cost one, and messages in thin places are in no cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.functions.text import lint_words
from tutorlens.operators.components import components
from tutorlens.operators.sampling import KEY, drawn
from tutorlens.sources.shared import settled

#: Messages of a cluster at least, the overlap of linked texts in hundredths of the union, and bands of so many hashes each.
LEAST, PERCENT, BANDS, ROWS = 5, 50, 20, 3


def band(words: Column, b: int, rows: int = ROWS) -> Column:
    """The signature of a band: for each row the smallest hash of a word."""
    return F.md5(F.concat_ws("|", *[F.array_min(F.transform(words, lambda w, r=r: F.md5(F.concat(F.lit(f"{b}:{r}:"), w)))) for r in range(rows)]))


def clusters(messages: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """(key, text, text_id, cluster) of messages (key, text): `cluster` is the smallest text_id of its texts, null outside of all clusters.

    Texts with the same words, in any order, are one (text_id is a hash of them). Null texts and
    those without words are in no cluster; repeated messages count each.
    """
    words = F.array_sort(F.array_distinct(lint_words(F.coalesce("text", F.lit("")))))
    cut = settled(messages.select(*KEY, "text", words.alias("words")).withColumn("text_id", F.when(F.size("words") > 0, F.md5(F.array_join("words", " ")))))
    known = cut.filter("text_id IS NOT NULL").groupBy("text_id").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    known = settled(known)
    signed = known.select("text_id", "n", F.posexplode(F.array(*[band(F.col("words"), b) for b in range(BANDS)])).alias("b", "signature"))
    dense = signed.groupBy("b", "signature").agg(F.min("text_id").alias("hub"), F.sum("n").alias("messages"), F.count("*").alias("texts")).filter((F.col("messages") >= least) & (F.col("texts") > 1))
    pairs = signed.join(dense, ["b", "signature"]).filter(F.col("text_id") != F.col("hub")).select("hub", "text_id").distinct()
    own, theirs = known.select("text_id", F.col("words").alias("x")), known.select(F.col("text_id").alias("hub"), F.col("words").alias("y"))
    near = 100 * F.size(F.array_intersect("x", "y")) >= percent * F.size(F.array_union("x", "y"))
    links = pairs.join(own, "text_id").join(theirs, "hub").filter(near).select("hub", "text_id")
    placed = known.join(components(links, "hub", "text_id"), F.col("text_id") == F.col("node"), "left").select("text_id", "n", F.coalesce("component_id", "text_id").alias("cluster"))
    large = placed.groupBy("cluster").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    named = placed.join(large, "cluster").select("text_id", "cluster")
    return cut.drop("words").join(named, "text_id", "left").select(*KEY, "text", "text_id", "cluster")


def described(members: DataFrame, examples: int = 3, seed: int = 0) -> DataFrame:
    """(cluster, n_messages, n_texts, examples) of each cluster, with some of its messages' texts at random."""
    inside = members.filter("cluster IS NOT NULL")
    drawn_ = inside.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(drawn(seed, *KEY), *KEY))).filter(F.col("place") <= examples)
    shown = drawn_.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("examples"))
    return inside.groupBy("cluster").agg(F.count("*").alias("n_messages"), F.countDistinct("text_id").alias("n_texts")).join(shown, "cluster")
