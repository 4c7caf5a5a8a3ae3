"""A corpus pipeline: five stages, each one operator of `tutorlens.llm` applied to what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`. Empty tables pass through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm import decontaminate, language_id, mixing, ngram_join, sharding
from tutorlens.llm.tables import added, settled, table

#: A prediction surer than this is accepted; two machines that are both undecided give 0.25.
LEAST_SCORE = 0.3
#: Ids of dropped copies that may be broadcast (about 50 MB as a hash table).
BROADCAST_COPIES = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; texts without letters, null ones included, go."""
    model = language_id.fit_documents(docs)
    lang, score = added(docs, "lang_pred", "score")
    sure = (F.col(lang) != language_id.UND) & (F.col(score) >= LEAST_SCORE)
    return language_id.identify(docs, model).filter(sure).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Documents without words or id are no duplicates.

    Of rows that repeat an id and its text one stays; ids that repeat are few or none, and only
    their rows are compared. Rows that share the id of a dropped copy go with it.
    """
    joined = settled(ngram_join.ngram_join(docs))
    copies = settled(joined.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    few = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies  # texts stay where they are
    left = docs.join(few, "doc_id", "left_anti").select(docs.columns)
    again = settled(joined.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: each document as often as its source's target takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, shards near equal in bytes."""
    return sharding.shard(docs).select(*docs.columns, *[c for c in added(docs, "size", "text_crc32", "old_shard", "block", "shard", "slot") if c.startswith(("size", "shard", "slot"))])


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_benchmark_text),
    ("mix_sources", mix_sources),
    ("shard", shard),
]
#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
