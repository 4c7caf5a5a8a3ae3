"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger holds one row
for each (blob, rule, rule version) that was scanned, with the spans found, so a run scans
only pairs that no earlier run has seen: copies, unchanged files and old versions cost a
hash. Findings are then joined back to every path (document) that holds the blob.

A cheap JVM pattern that each rule must satisfy somewhere goes first: blobs that cannot
match any rule are settled without leaving the JVM, and only the text of the others is
gathered, once per blob however many copies there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.tables import added, fresh_folder, table
from tutorlens.llm.words import slices


class Rule(NamedTuple):
    """`pattern` finds matches from the left; `keeps` says which of them count; `hint` is a JVM pattern that a text with a finding always matches."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str
    any_case: bool = False


#: The kinds of secrets and their forms, in the order that breaks ties.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:pass(?:word|wd)|secret|token|api_?key)", True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
)
LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Rules of the first run over a repository's history in the query; the second run brings the others.
FIRST_RULES = 3


def find(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Start and end, in code points, of the rule's findings."""
    pattern = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


def blob_id(text: str) -> F.Column:
    """The content address of a text column: the SHA-256 of its bytes; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of `versions` that `ledger` lacks.

    A null text is the empty blob; a text of any length is scanned whole, in slices of a few
    megabytes or alone if it is larger. Repeated texts are one blob; an empty table gives no rows.
    Other columns of `versions`, of whatever name, are not read. Only pairs with findings
    carry spans; the rest are recorded with an empty list, so they are never scanned again.
    """
    blobs = versions.select(blob_id(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.col("body").rlike(r.hint).alias("may")) for r in rules])
    pairs = blobs.withColumn("wanted", wanted).withColumn("body", F.when(F.exists("wanted", lambda w: w["may"]), F.col("body")))
    # copies meet after a map-side step that keeps one row of each blob; bodies of blobs without a hint are already null
    pairs = pairs.groupBy("blob").agg(F.first("body").alias("body"), F.first("wanted").alias("wanted"))
    if ledger is not None:  # what is known of a blob is one row, so a body is met once, whatever rules are new to it
        done = ledger.groupBy(F.col("blob").alias("known")).agg(F.collect_set(F.struct("rule", "rule_version")).alias("done"))
        fresh = F.filter("wanted", lambda w: ~F.coalesce(F.array_contains("done", F.struct(w["rule"], w["rule_version"])), F.lit(False)))
        pairs = pairs.join(done, F.col("blob") == F.col("known"), "left").withColumn("wanted", fresh).drop("known", "done")
    pairs = pairs.filter(F.size("wanted") > 0)
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                rows = [
                    (blob, w["rule"], w["rule_version"], [{"start": a, "end": b} for a, b in find(body, by_name[w["rule"]])] if w["may"] else [])
                    for blob, body, wanted in zip(*(batch.column(c).to_pylist() for c in ("blob", "body", "wanted")), strict=True) for w in wanted
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), SPANS), strict=True)], ["blob", "rule", "rule_version", "spans"])

    may = F.exists("wanted", lambda w: w["may"])
    clean = pairs.filter(~may).select("blob", F.explode("wanted").alias("w")).select("blob", "w.rule", "w.rule_version", F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return pairs.filter(may).select("blob", "body", "wanted").mapInArrow(run, LEDGER).unionByName(clean)


def extend_ledger(spark: SparkSession, versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at `path` lacks, appends it there, and returns the whole ledger.

    An append is committed as a whole, so a run that fails leaves the ledger as it was.
    """
    have = spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else None
    scan(versions, have, text, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def findings_by_path(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`versions` with a column `findings`: array of (start, rank, kind, end) in order of start, then of kind as in `rules`.

    Every path that holds a blob gets its findings, repeated rows each their own; null where there
    are none, as for null and empty texts. See `added` for a caller's column of that name.
    """
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    found = (
        ledger.filter((F.size("spans") > 0) & (F.col("rule_version") == current[F.col("rule")]))
        .select("blob", "rule", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("s.start"), ranks[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), F.col("s.end")))).alias("__ss_findings"))
    )
    (name,) = added(versions, "findings")
    return versions.withColumn("__ss_blob", blob_id(text)).join(found.withColumnRenamed("blob", "__ss_blob"), "__ss_blob", "left").drop("__ss_blob").withColumnRenamed("__ss_findings", name)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the ledger, in two runs: the second brings more rules, and scans only pairs that the first has not seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_folder(spark, "secret-ledger")
    extend_ledger(spark, docs, path, rules=RULES[:FIRST_RULES])
    ledger = extend_ledger(spark, docs, path)
    # only addresses travel from here on; the text is not needed any more
    found = findings_by_path(docs.select("doc_id", "text"), ledger).drop("text")
    joined = lambda kinds: F.array_join(F.transform(F.filter(F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")), lambda f: f["rank"] < kinds), lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda kind: F.coalesce(F.size(F.filter("findings", lambda f: f["kind"] == kind)), F.lit(0)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(3), 256).alias("base_sha256"),
        joined(len(RULES)).alias("spans"),
    )
