"""Course profiles and label schemas: lint against student text, composition, brevity, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlens.functions.text import lint_words, shingle_hashes, word_count
from tutorlens.operators.sampling import KEY


#: Hashes of artifact shingles that may be broadcast (8 bytes each, about 40 MB as a hash table).
BROADCAST_SHINGLES = 1_000_000


def lint_overlap(artifacts: DataFrame, student: DataFrame, width: int = 8) -> DataFrame:
    """`where` of every artifact string (where, text) that shares a run of `width` words with any student text.

    Runs are compared by 64-bit hashes. The artifacts' are few and go to the students' by a
    semi-join, broadcast while their number is small, so student runs are matched where they are made.
    """

    def grams(df: DataFrame, *keep: str) -> DataFrame:
        # the words are a column of their own, so that they are cut out once and not for every shingle; an outer
        # generator has no filter on the size of its array inferred, for which it would be computed twice
        words = df.select(*keep, lint_words(F.col("text")).alias("words")).filter(F.size("words") >= width)
        return words.select(*keep, F.explode_outer(shingle_hashes(F.col("words"), width)).alias("g"))

    own = grams(artifacts, "where").distinct()
    wanted = own.select("g").distinct()
    said = grams(student).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_SHINGLES else wanted, "g", "left_semi").distinct()
    return own.join(said, "g", "left_semi").select("where").distinct()


def brevity(fields: DataFrame, cap: Column) -> DataFrame:
    """(name, field, words, cap) of the fields (name, field, text) with more words than their cap."""
    w = fields.withColumn("words", word_count(F.col("text"))).withColumn("cap", cap)
    return w.filter(F.col("words") > F.col("cap")).select("name", "field", "words", "cap")


def compose(*layers: DataFrame) -> DataFrame:
    """(position, name, layer) of all labels of (ord, name) layers, in order of layers; a name in two layers is an error."""
    every = None
    for i, layer in enumerate(layers):
        one = layer.select(F.lit(i).alias("layer"), "ord", "name")
        every = one if every is None else every.unionByName(one)
    clash = every.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").orderBy("name").limit(1).collect()
    if clash:
        raise ValueError(f"label name collision in composition: {clash[0]['name']!r}")
    return every.orderBy("layer", "ord")


def categories(*layers: tuple[str, DataFrame]) -> DataFrame:
    """(name, category): the last layer that has a name decides its category."""
    every = None
    for i, (category, names) in enumerate(layers):
        one = names.select("name", F.struct(F.lit(i).alias("rank"), F.lit(category).alias("category")).alias("c"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("name").agg(F.max("c")["category"].alias("category"))


def content_hash(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 12)


def todo(messages: DataFrame, labeled: DataFrame, schema_version: str) -> DataFrame:
    """Messages without a verdict of this schema version; verdicts of other versions do not count."""
    done = labeled.filter(F.col("schema_version") == schema_version).select(*KEY).distinct()
    return messages.join(done, list(KEY), "left_anti")


def digest(turns: DataFrame, per_conversation: int = 4, chars: int = 160) -> DataFrame:
    """(conv_id, digest): a head line and the first student turns, cut to `chars` characters each."""
    said = turns.filter("role = 'student'")
    n = said.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("notebook").alias("notebook"))
    cut = said.filter(F.col("student_index") < per_conversation).select("conv_id", "student_index", F.concat(F.lit("  student: "), F.substring("text", 1, chars)).alias("line"))
    lines = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("student_index", "line"))).alias("lines"))
    head = F.concat(F.lit("["), F.coalesce(F.nullif("notebook", F.lit("")), F.lit("unknown")), F.lit(" · "), F.col("n"), F.lit(" student turns]"))
    return n.join(lines, "conv_id").select("conv_id", F.array_join(F.concat(F.array(head), F.col("lines.line")), "\n").alias("digest"))
