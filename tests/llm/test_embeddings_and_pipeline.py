"""Near-duplicate embeddings against brute force, and the pipeline stage by stage."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import brute_components, corpus, frame, lines
from tutorlens.llm import embedding_dedup as E

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(seed: int = 0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.choice([1, 2, 30]))):
            rows.append(centre + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.35]))
    rows += [rows[0]] * 4 + [rows[3] * 2.5]
    out = [(i, [float(x) for x in r], 0) for i, r in enumerate(rows)]
    n = len(out)
    bad = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [None] + [1.0] * 31, [], [1.0, 2.0]]
    return out + [(n + i, b, 1) for i, b in enumerate(bad)] + [(None, out[0][1], 0)]


def brute(rows):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(ok) for b, y in ok[k + 1 :] if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9]
    return links, brute_components([i for i, *_ in rows if i is not None], links)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates(spark, monkeypatch, block):
    """With recall asked for near 1 every pair is found, also where buckets are cut into small blocks."""
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors()
    links, want = brute(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit("x")).withColumn("kept", F.lit("x"))
    got = E.near_duplicates(df, recall=0.999999).collect()
    assert len(got) == len(rows)
    count = {i: sum(i in p for p in links) for i, *_ in rows}
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])


def test_recall_at_the_production_shape(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = rng.uniform(0.9005, 0.95)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y).tolist(), 0)]
    links, _ = brute(rows)
    got = E.near_duplicates(spark.createDataFrame(rows, VECTORS)).agg(F.sum("n_links")).collect()[0][0] / 2
    assert len(links) >= 295 and 0.9 * len(links) <= got <= len(links)


def test_chains_large_groups_and_extreme_vectors(spark, monkeypatch):
    """A chain of neighbours, a group larger than a block, and vectors whose squares overflow or vanish."""
    monkeypatch.setattr(E, "BLOCK", 64)
    rng = np.random.default_rng(4)
    angle = math.acos(0.93)
    chain = [[math.cos(k * angle), math.sin(k * angle), *[0.0] * 14] for k in range(9)]
    centre = rng.standard_normal(16)
    group = [(centre + rng.standard_normal(16) * 0.08).tolist() for _ in range(300)]
    base = np.abs(rng.standard_normal(16)) + 0.5
    extreme = [(base * f).tolist() for f in (1e200, 3e-200, 1.0, 1e-300)]
    rows = [(i, v, 0) for i, v in enumerate([*chain, *group, *extreme])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    ok = [(i, E.scaled(np.array([v]))[0]) for i, v, _ in rows]
    links = [(a, b) for k, (a, x) in enumerate(ok) for b, y in ok[k + 1 :] if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9]
    want, count = brute_components([i for i, *_ in rows], links), {i: sum(i in p for p in links) for i, *_ in rows}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df, recall=0.999999).collect()}
    assert got == {i: (count[i], want[i]) for i in want}
    assert want[8] == 0 and count[len(rows) - 1] >= 3


def test_embedding_query(spark, tmp_path):
    rows = vectors(2)
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = E.op10_embedding_dedup(spark, str(tmp_path)).collect()
    links, want = brute(rows)
    assert len(got) == len(rows) and set(got[0].asDict()) >= {"vec_id", "n_links", "component_id", "kept"}
    assert sum(r["n_links"] for r in got) >= 0.95 * 2 * len(links)


def test_empty_vectors(spark):
    assert E.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("n", [0, 1000, 10**6, 10**10])
def test_shape_keeps_recall(n):
    """Pairs right at the threshold share a code in some table, with codes that are bits of one sketch."""
    bits, tables = E.shape(n)
    assert n <= 64 * 16 or n / 2**bits <= 64 or bits == 28
    rng, which, h = np.random.default_rng(n % 97), E.chosen(bits, tables, 0), E.planes(64, 0)
    x, y = rng.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.9 * x + math.sqrt(0.19) * y / np.linalg.norm(y, axis=1)[:, None]
    apart = (x @ h > 0) != (y @ h > 0)
    met = np.zeros(2000, bool)
    for at in which:
        met |= ~apart[:, at].any(axis=1)
    assert met.mean() >= 0.965  # the mean is 0.98; a sketch's hyperplanes are drawn once for all pairs
    assert tables < E.MOST_TABLES and E.SKETCH % 64 == 0


def documents():
    rng = random.Random(9)
    rows = [(i, lines(lang := rng.choice(["en", "de", "fr", "es"]), rng, rng.choice([40, 80])) + f" only{i} " + lines(lang, rng, 9), lang, f"s{i % 3}", 0) for i in range(150)]
    copies = [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(10)] + [(300 + i, rows[i][1] + " more", rows[i][2], "s1", 0) for i in range(5)]
    leaks = [(400, rows[20][1] + " " + ITEM + " " + rows[21][1], "en", "s0", 0), (401, ITEM.upper(), "en", "s2", 0)]
    odd = [(500, None, None, None, None), (501, "1234 !!", "en", "s0", 0), (502, "", "en", "s1", 0)]
    return rows + copies + leaks + odd


ITEM = "item zero about the mitochondria and of to in that for this"


def test_pipeline_stages(spark, tmp_path):
    frame(spark, documents()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns if k < 4 else set(columns) < set(out.columns)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    ids = {r[0] for r in documents()}
    assert set(kept["language_id"]) == ids - {500, 501, 502}
    assert set(kept["ngram_join"]) == set(range(150)) | {400, 401}
    assert set(kept["decontaminate"]) == set(range(150))
    assert set(kept["mix_sources"]) <= set(range(150)) and kept["shard"] == kept["mix_sources"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["shard"])


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Rows that repeat an id and its text leave the second stage once, those without words or id all stay."""
    rows = documents()[:150]
    again = [rows[3], rows[3], rows[4], (None, rows[5][1], "en", "s", 0), (None, rows[5][1], "en", "s", 0), (600, "", "en", "s", 0), (600, "", "en", "s", 0)]
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows + again), str(tmp_path)).collect()]
    assert sorted(k for k in kept if k is not None) == [*range(150), 600, 600] and kept.count(None) == 2


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ("score", "lang_pred", "size", "shard", "slot", "spans", "copies", "component_id")
    docs = frame(spark, documents()[:40]).withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert out and all(r[c] == f"{c}{r['doc_id']}" for r in out for c in names), name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_rows_without_text(spark, tmp_path):
    """Every stage takes null and empty texts, and rows that repeat, on its own."""
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, corpus(8, 20) + corpus(8, 2))
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, str(tmp_path)).count()
        assert n > 0, name
