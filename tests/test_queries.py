"""Every query against its SQL on the smallest tables, and results that do not depend on partitioning."""

from __future__ import annotations

import os

import pytest

from tutorlens.plans import catalogue, workflow  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "events", "documents", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (bool, int, str, type(None))) else float(v) if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_queries_without_sql_run(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"trajectory_archetypes"}
    rows = catalogue.QUERIES["trajectory_archetypes"](spark, SF).collect()
    assert rows and all(0 < r["share"] <= 1 for r in rows)


def test_partitioning_does_not_matter(spark):
    names = ("sequence_outcomes", "message_facts", "stratified_sample", "audit_sample", "length_terciles")
    one = {n: sorted(map(str, catalogue.QUERIES[n](spark, SF).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert {n: sorted(map(str, catalogue.QUERIES[n](spark, SF).collect())) for n in names} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
