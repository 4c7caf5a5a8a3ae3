"""Immutable snapshots, and readers that fill in what older files lack."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "chatlog_id bigint, message_index int, labels map<string,boolean>, rationales map<string,string>, evidence map<string,string>, no_label_fits boolean, coverage_note string, forms array<string>, concepts array<string>, move string, latency_seconds double, latency_bucket string, mode string, defected boolean, question_ref string, pre_pattern string, seq_granularity string, attempted boolean, error_verified boolean"
AUDIT = "rows array<struct<chatlog_id:bigint,message_index:int,labels:map<string,boolean>,no_label_fits:boolean>>"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def emit(spark: SparkSession, folder: str, name: str, tables: dict[str, DataFrame], schema: dict, provenance: dict) -> str:
    """Writes the tables as JSON lines, the schema and a manifest with row counts, and returns the snapshot's path.

    All is written to a staging folder first, the manifest last, and renamed when complete. A
    taken name gets -2, -3, ...; after a failure nothing is left. Where a store cannot rename at
    once, the manifest tells a complete snapshot from a partial one.
    """
    fs, base = _fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging = path(base, f".{name}-{uuid.uuid4().hex}")
    try:
        counts = {}
        for table, df in tables.items():
            df.write.mode("errorifexists").json(f"{staging}/{table}.jsonl")
            counts[table] = spark.read.text(f"{staging}/{table}.jsonl").count()
        for file, value in (("schema.json", schema), ("manifest.json", provenance | {"row_counts": counts})):
            out = fs.create(path(staging, file), False)
            out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
            out.close()
        n = 1
        while True:
            final = path(base, name if n == 1 else f"{name}-{n}")
            if not fs.exists(final):
                if fs.rename(staging, final):
                    return final.toString()
                if not fs.exists(final):  # not taken by another writer in between
                    raise OSError(f"cannot rename {staging} to {final}")
            n += 1
    except BaseException:
        fs.delete(staging, True)
        raise


def write_json(spark: SparkSession, path: str, value: dict) -> str:
    """Writes a small JSON file, a profile or a schema, over one that is there."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    return at.toString()


def read_json_file(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))  # a schema or manifest


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows of any age: fields that a file lacks get their defaults."""
    empty = lambda kind: F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind)
    df = spark.read.schema(LABELS).json(path)
    fill = {"rationales": "map<string,string>", "evidence": "map<string,string>", "forms": "array<string>", "concepts": "array<string>"}
    df = df.withColumns({c: F.coalesce(c, empty(kind)) for c, kind in fill.items()})
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("no_label_fits", "defected")})
    return df.na.fill("", ["coverage_note", "move", "latency_bucket", "mode", "question_ref", "pre_pattern", "seq_granularity"])


def read_audit(spark: SparkSession, path: str, annotator: int = 0) -> DataFrame:
    """The judged pairs of an audit file, {rows, strata} or a bare list of rows, in long form."""
    row = "struct<chatlog_id:bigint,message_index:int,labels:map<string,boolean>,no_label_fits:boolean>"
    whole = spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{row}>")).otherwise(F.from_json("value", AUDIT)["rows"])
    r = whole.select(F.explode(rows).alias("r"))
    return r.select(F.lit(annotator).alias("annotator"), "r.chatlog_id", "r.message_index", F.explode("r.labels").alias("label", "applies"))


def read_materials(spark: SparkSession, path: str, chars: int = 20_000) -> DataFrame:
    """(path, text): one row per file, cut to `chars` characters."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.substring("value", 1, chars).alias("text"))
