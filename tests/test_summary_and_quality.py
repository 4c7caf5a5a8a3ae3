"""Summaries, quality measures, samples, profiles, verdicts, snapshots and the session, against values worked out by hand."""

from __future__ import annotations

import json
import math
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tutorlens.operators import labeling, profile, quality, sampling, summary, verdicts
from tutorlens.params import Params, content_hash
from tutorlens.plans import audit, session
from tutorlens.plans.session import Concept, Label, PhaseError, Profile, Session, accept_profile, described, ensure_distilled, oversized
from tutorlens.sources import events, snapshot
from tutorlens.streaming.incremental import label_stream

V = "chatlog_id bigint, message_index int, label string, label_ord int, applies boolean, no_label_fits boolean, rationale string, mode string"


def table(spark, rows):
    """Verdicts from {(chatlog, message): set of labels that apply}, for the labels a and b."""
    out = [(c, m, x, i, x in on, "none" in on, f"{x} said so" if x in on else "", "tutor") for (c, m), on in rows.items() for i, x in enumerate("ab")]
    return spark.createDataFrame(out, V)


def test_totals_round_half_to_even(spark):
    v = table(spark, {(1, 0): {"a"}, (1, 1): {"a", "b"}, (2, 0): {"a"}, (3, 0): {"b"}, (3, 1): set(), (3, 2): set(), (4, 0): set(), (4, 1): set()})
    assert tuple(summary.totals(v).collect()[0]) == (8, 4, 4, 1.2)
    assert tuple(summary.totals(v.limit(0)).collect()[0]) == (0, 0, 0, 0.0)


def test_prevalence_keeps_unused_labels(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "label_ord int, label string")
    v = table(spark, {(1, 0): {"a"}, (1, 1): set()})
    assert [(r["label"], r["n"], r["share"]) for r in summary.prevalence(v, labels).orderBy("label_ord").collect()] == [("a", 1, 0.5), ("b", 0, 0.0), ("z", 0, 0.0)]


def test_weekly_and_jump(spark):
    v = table(spark, {(1, 0): {"a"}, (1, 1): {"a", "b"}, (2, 0): set(), (3, 0): {"a"}, (3, 1): set(), (9, 0): {"a"}})
    weeks = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (9, None)], "chatlog_id bigint, week bigint")
    got = {(r["week"], r["label"]): r["share"] for r in summary.weekly(v, weeks).collect()}
    assert [got[w, "a"] for w in (0, 1, 3)] == [1.0, 0.0, 0.5]
    assert tuple(summary.largest_jump(summary.weekly(v, weeks)).collect()[0]) == ("a", 1, -1.0)
    assert summary.weekly(v, weeks.filter("week < 3")).count() == 0
    gap = weeks.withColumn("week", F.col("week") * 2)
    assert summary.largest_jump(summary.weekly(v, gap)).count() == 0


def test_pairs_and_overlap(spark):
    rows = {(i, 0): {"a", "b"} for i in range(8)} | {(8, 0): {"a"}, (9, 0): {"b"}, (10, 0): set(), (11, 0): set()}
    v = table(spark, rows)
    r = summary.label_overlap(v).collect()
    assert [(x["a"], x["b"], x["jaccard"], x["n_both"]) for x in r] == [("a", "b", 0.8, 8)] and abs(r[0]["rationale_overlap"] - 0.5) < 1e-9
    assert summary.top_pairs(v).collect()[0]["share"] == 8 / 12
    assert summary.label_overlap(v, 0.81).count() == 0


def test_coverage(spark):
    v = table(spark, {**{(1, i): {"a"} for i in range(20)}, (2, 0): {"a"}, (3, 0): {"none"}})
    heads = spark.createDataFrame([(1,), (2,), (3,), (4,)], "chatlog_id bigint")
    got = {r["bin"]: r["n"] for r in summary.coverage_histogram(v, heads).collect()}
    assert len(got) == 16 and (got[0], got[1], got[15]) == (2, 1, 1)
    assert tuple(summary.abstention(v).collect()[0])[:2] == (1, 22)
    firsts = spark.createDataFrame([(3, "x")], "chatlog_id bigint, text string")
    assert [r["chatlog_id"] for r in summary.zero_examples(v, heads, firsts, 5, 1).collect()] == [3]


def test_mode_split(spark):
    v = table(spark, {(1, 0): {"a"}, (2, 0): {"a"}, (3, 0): {"a"}}).withColumn("mode", F.when(F.col("chatlog_id") == 1, "tutor").when(F.col("chatlog_id") == 2, "chatgpt").otherwise(""))
    assert tuple(summary.mode_split(v).collect()[0]) == ("a", 1, 1, 1, 0)
    odd = v.withColumn("mode", F.when(F.col("chatlog_id") == 3, "voice").otherwise(F.col("mode")))
    assert tuple(summary.mode_split(odd).collect()[0]) == ("a", 1, 1, 0, 1)


def audit_of(spark, cells):
    """(human, model) pairs for one label."""
    a = spark.createDataFrame([(0, i, 0, "x", h) for i, (h, _) in enumerate(cells)], "annotator int, chatlog_id bigint, message_index int, label string, applies boolean")
    v = spark.createDataFrame([(i, 0, "x", m) for i, (_, m) in enumerate(cells)], "chatlog_id bigint, message_index int, label string, applies boolean")
    return a, v


def test_confusion(spark):
    cells = [(True, True)] * 3 + [(False, True)] * 2 + [(True, False)] + [(False, False)] * 4
    a, v = audit_of(spark, cells)
    r = quality.confusion(a, v).collect()[0]
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"], r["agreement"], r["support"]) == (3, 2, 1, 4, 0.6, 0.75, 0.7, 4)
    assert abs(r["specificity"] - 4 / 6) < 1e-12 and abs(r["kappa"] - 0.4) < 1e-9
    assert abs(r["corrected_prevalence"] - (0.5 + 4 / 6 - 1) / (0.75 + 4 / 6 - 1)) < 1e-9
    one = quality.confusion(*audit_of(spark, [(True, True)] * 3)).collect()[0]
    assert one["kappa"] is None and one["specificity"] is None and one["corrected_prevalence"] is None
    worse = quality.confusion(*audit_of(spark, [(True, False), (False, True)])).collect()[0]
    assert worse["corrected_prevalence"] is None and worse["kappa"] == -1.0
    assert quality.missing_verdicts(a, v.filter("chatlog_id > 0")).count() == 1
    # a label that the model's row lacks is not applied; a message that it never labeled is an error
    rows = [(0, 1, 0, "x", True), (0, 1, 0, "y", True), (0, 2, 0, "x", False)]
    audit = spark.createDataFrame(rows, "annotator int, chatlog_id bigint, message_index int, label string, applies boolean")
    model = spark.createDataFrame([(1, 0, "x", True), (2, 0, "y", True)], "chatlog_id bigint, message_index int, label string, applies boolean")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in quality.confusion(audit, model).collect()}
    assert got == {"x": (1, 0, 0, 1), "y": (0, 0, 1, 0)}
    with pytest.raises(Exception, match="no verdicts for message 2:0"):
        quality.confusion(audit, model.filter("chatlog_id = 1")).collect()
    # pairs that nobody judged do not count
    assert quality.confusion(a.filter("chatlog_id < 3"), v).collect()[0]["tp"] == 3


def test_validation_table_and_admission(spark):
    a, v = audit_of(spark, [(True, True)] * 30 + [(False, False)] * 30 + [(False, True)])
    t = quality.validation_table(a, v, spark.createDataFrame([("x", 0.9)], "label string, ceiling double"))
    assert not t.collect()[0]["near_chance"] and quality.admitted(t).count() == 1
    assert quality.admitted(t, support=31).count() == 0


def test_anchors(spark):
    v = table(spark, {(i, 0): {"a"} if i < 4 else set() for i in range(10)})
    facts = spark.createDataFrame([(i, 0, "fail-then-ask" if i < 3 else "ask-first") for i in range(10)], "chatlog_id bigint, message_index int, pre_pattern string")
    anchors = spark.createDataFrame([("a", "fail-then-ask"), ("a", "ask-first"), ("b", "ask-first")], "label string, expected_pattern string")
    got = {(r["label"], r["expected_pattern"]): (r["in_pattern"], r["total_positives"], r["concentration"], r["baseline"], r["flagged"]) for r in quality.outcome_anchors(v, facts, anchors).collect()}
    assert got == {("a", "fail-then-ask"): (3, 4, 0.75, 0.3, False), ("a", "ask-first"): (1, 4, 0.25, 0.7, True), ("b", "ask-first"): (0, 0, 0.0, 0.7, False)}


def test_entropy(spark):
    rows = [(r, m, 0, "x", r < yes) for m, yes in enumerate((5, 3, 2)) for r in range(5)]
    e = quality.vote_entropy(spark.createDataFrame(rows, "run int, chatlog_id bigint, message_index int, label string, applies boolean"))
    got = {r["chatlog_id"]: r["max_entropy"] for r in e.collect()}
    want = -(0.6 * math.log2(0.6) + 0.4 * math.log2(0.4))
    assert got[0] == 0 and abs(got[1] - want) < 1e-9 and abs(got[2] - want) < 1e-9
    assert {r["chatlog_id"] for r in sampling.most_uncertain(e, 2).collect()} == {1, 2}


def annotators(spark, *rows):
    return spark.createDataFrame([(a, k, 0, label, said) for a, own in enumerate(rows) for (k, label), said in own.items()], "annotator int, chatlog_id bigint, message_index int, label string, applies boolean")


def test_alt_test(spark):
    one = {(k, "x"): k % 2 == 0 for k in range(6)}
    model = lambda d: spark.createDataFrame([(k, 0, label, said) for (k, label), said in d.items()], "chatlog_id bigint, message_index int, label string, applies boolean")
    with pytest.raises(Exception, match="two annotators"):
        quality.alt_test(annotators(spark, one), model(one)).collect()
    good = quality.alt_test(annotators(spark, one, one), model(one))
    assert all(r["advantage"] == 1.0 and r["wins"] and r["n_items"] == 6 for r in good.collect()) and quality.alt_test_passes(good).collect()[0]["passes"]
    bad = quality.alt_test(annotators(spark, one, one), model({k: not v for k, v in one.items()}))
    assert all(r["advantage"] == 0.0 and not r["wins"] for r in bad.collect()) and not quality.alt_test_passes(bad).collect()[0]["passes"]
    # a label that one annotator skipped is not scored
    extra = one | {(0, "y"): True}
    assert {r["n_items"] for r in quality.alt_test(annotators(spark, one, extra), model({k: not v for k, v in extra.items()})).collect()} == {6}


def test_flips(spark):
    o = spark.createDataFrame([(i, 0, x, True) for i in range(3) for x in ("deictic", "surface")], "chatlog_id bigint, message_index int, label string, applies boolean")
    a = o.filter("chatlog_id < 2").withColumn("applies", F.col("label") == "surface")
    got = {r["label"]: (r["flips"], r["total"]) for r in quality.flip_stats(o, a).collect()}
    assert got == {"deictic": (2, 2), "surface": (0, 2)} and tuple(quality.messages_with_flips(o, a).collect()[0]) == (2, 2)
    less = a.filter("label = 'surface' OR chatlog_id = 0")  # a label that is gone counts as not applied
    assert {r["label"]: (r["flips"], r["total"]) for r in quality.flip_stats(o, less).collect()} == {"deictic": (2, 2), "surface": (0, 2)}
    with pytest.raises(Exception, match="no original verdicts for message 1:0"):
        quality.flip_stats(o.filter("chatlog_id <> 1"), a).collect()


def pool(spark):
    return spark.createDataFrame([(i, 0, i < 3) for i in range(20)], "chatlog_id bigint, message_index int, no_label_fits boolean")


def test_audit_sample(spark):
    got = sampling.audit_sample(pool(spark), None, 10, 1).collect()
    kinds = [r["audit_stratum"] for r in got]
    assert len(got) == 10 and kinds.count("abstained") == 3 and len({r["chatlog_id"] for r in got}) == 10
    e = pool(spark).select("chatlog_id", "message_index", (F.col("chatlog_id") % 10 / 10.0).alias("max_entropy"))
    kinds = [r["audit_stratum"] for r in sampling.audit_sample(pool(spark), e, 10, 1).collect()]
    assert (kinds.count("abstained"), kinds.count("high-entropy"), kinds.count("random")) == (3, 5, 2)
    left = sampling.excluded(pool(spark), pool(spark).filter("chatlog_id >= 5"))
    assert {r["chatlog_id"] for r in sampling.audit_sample(left, None, 10, 1).collect()} == set(range(5))


def test_label_audit_samples(spark):
    rows = [(i, 0, "x", i < 6, 6 <= i < 8) for i in range(30)]
    p = spark.createDataFrame(rows, "chatlog_id bigint, message_index int, label string, applies boolean, no_label_fits boolean")
    kinds = lambda n, f: [r["audit_stratum"] for r in sampling.label_audit_samples(p, n, 1, f).collect()]
    k = kinds(8, 0.5)
    assert (k.count("model-positive"), k.count("abstained-negative"), k.count("random-negative")) == (4, 2, 2)
    k = kinds(10, 0.8)
    assert (k.count("model-positive"), len(k)) == (6, 10)
    places = sorted(r["place"] for r in sampling.label_audit_samples(p, 8, 1).collect())
    assert places == list(range(1, 9))
    for wrong in (0, 1, -0.2):
        with pytest.raises(ValueError):
            sampling.label_audit_samples(p, 8, 1, wrong)


def test_first_seen_and_recent(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, o int")
    assert {r["k"]: r["o"] for r in sampling.first_seen(df, "k", "o").collect()} == {"a": 2, "b": 1}
    feed = spark.createDataFrame([(i, 0, i * 10) for i in range(5)], "chatlog_id bigint, message_index int, us bigint")
    assert [r["chatlog_id"] for r in sampling.recent(feed).collect()] == [4, 3, 2]


def test_lint_and_brevity(spark):
    said = spark.createDataFrame([("I really don't know how to group this table by hand",), ("short",), (None,)], "text string")
    art = spark.createDataFrame([("quote", "they REALLY don't know how to group this table"), ("fine", "they ask how to group"), ("seven", "know how to group this table by")], "where string, text string")
    assert [r["where"] for r in profile.lint_overlap(art, said).collect()] == ["quote"]
    with pytest.raises(ValueError):
        ensure_distilled(art, said)
    with pytest.raises(ValueError):
        ensure_distilled(art.filter("where = 'fine'"), said, accepted=False)
    ensure_distilled(art.filter("where = 'fine'"), said)
    f = spark.createDataFrame([("x", "description", "w " * 21), ("y", "description", " w" * 20)], "name string, field string, text string")
    assert [tuple(r) for r in profile.brevity(f, F.lit(20)).collect()] == [("x", "description", 21, 20)]
    assert oversized((Label("x", "w " * 21, "w " * 25, "w " * 26),)) == ["x.description (21w > 20w)", "x.negative_criteria (26w > 25w)"]


def test_compose(spark):
    layer = lambda *n: spark.createDataFrame(list(enumerate(n)), "ord int, name string")
    assert [r["name"] for r in profile.compose(layer("b", "a"), layer("c")).collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError, match="'a'"):
        profile.compose(layer("a"), layer("a"))
    got = {r["name"]: r["category"] for r in profile.categories(("affect", layer("x", "y")), ("concept", layer("y"))).collect()}
    assert got == {"x": "affect", "y": "concept"}
    c = spark.createDataFrame([("p",), ("q",), ("r",)], "name string")
    assert {r["name"]: r["promoted"] for r in accept_profile(c, ["q"], ["r"]).collect()} == {"p": False, "r": True}


def test_hashes():
    assert content_hash({"b": 1, "a": 2}) == content_hash({"a": 2, "b": 1}) and len(Params().version) == 12
    assert Params(seed=8).version != Params().version


def test_verdicts(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "my Loop fails"), (1, 2, None), (2, 0, "thanks")], "chatlog_id bigint, message_index int, text string")
    labels = spark.createDataFrame([("loops", "loop,while"), ("thanks", "thank")], "label string, cues string")
    got = {(r["chatlog_id"], r["message_index"], r["label"]): r for r in verdicts.ask(verdicts.fan_out(m, labels)).collect()}
    assert len(got) == 6 and got[1, 0, "loops"]["applies"] and got[1, 0, "loops"]["evidence"] == "loop" and got[2, 0, "loops"]["rationale"] == verdicts.NO_RATIONALE
    maps = verdicts.as_maps(verdicts.ask(verdicts.fan_out(m, labels)))
    assert {tuple(verdicts_) for verdicts_ in (r[0] for r in maps.select(verdicts.applied(F.col("labels"))).collect())} == {("loops",), (), ("thanks",)}
    assert verdicts.as_long(maps).count() == 6
    path = str(tmp_path / "v")
    assert labeling.label_messages(spark, m.limit(2), labels, path, "s1").count() == 2
    assert labeling.label_messages(spark, m, labels, path, "s1").count() == 3 and spark.read.parquet(path).count() == 3
    rows = labeling.label_messages(spark, m, labels, path, "s2")
    assert rows.count() == 3 and spark.read.parquet(path).count() == 6
    long = {(r["chatlog_id"], r["message_index"], r["label"]): r for r in labeling.as_long(rows, "forms").collect()}
    assert {k: (r["applies"], r["rationale"], r["evidence"]) for k, r in long.items()} == {k: (r["applies"], r["rationale"], r["evidence"]) for k, r in got.items()}
    one = {(r["chatlog_id"], r["message_index"]): r for r in rows.collect()}
    assert one[1, 0]["evidence"] == {"loops": "loop"} and not one[1, 0]["no_label_fits"] and one[1, 2]["no_label_fits"] and one[2, 0]["forms"] == ["nudge"]


LOOPS = [("loops", "loop"), ("tens", "1")]


def many(spark, n=40):
    m = spark.createDataFrame([(i, 0, f"loop {i}") for i in range(n)], "chatlog_id bigint, message_index int, text string")
    return m.repartition(3), spark.createDataFrame(LOOPS, "label string, cues string")


def noting(path):
    """The offline provider, which writes down what it is asked for."""

    def noted(rows):
        with open(path, "a") as out:
            out.writelines(f"{i}\n" for i in rows["chatlog_id"])
        return verdicts.offline(rows)

    return noted, lambda: {int(x) for x in open(path)} if os.path.exists(path) else set()


def test_failed_messages_hold_back_no_others(spark, tmp_path):
    m, labels = many(spark, 400)
    path, counts = str(tmp_path / "v"), {}

    def broken(rows):
        for i in (17, 203):
            if (rows["chatlog_id"] == i).any():
                raise OSError(f"no answer for {i}")
        return verdicts.offline(rows)

    ask = lambda provider, **more: labeling.label_messages(spark, m, labels, path, "s", provider, attempts=2, base_seconds=0, each=4, a_task=100, **more)
    with pytest.raises(labeling.LabelingError, match="2 messages.*17/0: no answer for 17; 203/0: no answer for 203"):
        ask(broken, on_progress=counts.update)
    kept = labeling.stored(spark, path)
    assert kept.count() == 398 and not {r["chatlog_id"] for r in kept.collect()} & {17, 203}
    assert (counts["messages"], counts["verdicts"], counts["failed"], counts["total"]) == (398, 796, 2, 400) and "no answer for 17" in counts["error"]
    assert {r["chatlog_id"]: r["times"] for r in labeling.failures(spark, path, "s").collect()} == {17: 1, 203: 1}
    few = labeling.compacted(spark, path, str(tmp_path / "few"))
    assert len(list((tmp_path / "few").glob("part-*"))) == 1 < len(list((tmp_path / "v").glob("part-*"))) and labeling.stored(spark, few, "s").count() == 398
    assert {r["chatlog_id"] for r in labeling.failures(spark, few, "s").collect()} == {17, 203}
    noted, asked = noting(str(tmp_path / "asked"))
    assert ask(noted).count() == 400 and asked() == {17, 203}
    assert labeling.failures(spark, path, "s").count() == 0 and ask(broken).count() == 400
    # a run that finishes nothing ends early, and the next one starts from what it left
    def never(rows):
        raise OSError("away")

    empty = str(tmp_path / "e")
    with pytest.raises(labeling.LabelingError, match="400 messages"):
        labeling.label_messages(spark, m, labels, empty, "s", never, attempts=1, a_task=200)
    assert labeling.stored(spark, empty).count() == 0 and labeling.ledger(spark, empty).count() <= 3 * labeling.FAILURES_IN_A_ROW
    assert labeling.label_messages(spark, m, labels, empty, "s").count() == 400


def test_messages_that_failed_come_last(spark, tmp_path):
    m, labels = many(spark)
    path = str(tmp_path / "v")

    def broken(rows):
        if (rows["chatlog_id"] < 20).any():
            raise OSError("poison")
        return verdicts.offline(rows)

    had = []
    for _ in range(5):
        with pytest.raises(labeling.LabelingError):
            labeling.label_messages(spark, m, labels, path, "s", broken, attempts=1, each=4, a_task=100)
        had.append(labeling.stored(spark, path).count())
    assert had == sorted(had) and had[-1] == 20


def test_an_answer_is_whole(spark, tmp_path):
    m, labels = many(spark, 6)

    def short(rows):
        return verdicts.offline(rows).iloc[: len(rows) - (rows["chatlog_id"] == 3).any()]

    with pytest.raises(labeling.LabelingError, match="1 messages.*3/0: 2 answers to 3 requests"):
        labeling.label_messages(spark, m, labels, str(tmp_path / "v"), "s", short, attempts=1, each=2)
    rows = labeling.stored(spark, str(tmp_path / "v")).collect()
    assert len(rows) == 5 and all(set(r["labels"]) == {"loops", "tens"} and r["forms"] and r["move"] for r in rows)


def test_requests_of_many_calls_are_written_together(monkeypatch):
    frames, real = [], labeling.requests
    monkeypatch.setattr(labeling, "requests", lambda messages, *rest: frames.append(len(messages)) or real(messages, *rest))
    asked = []

    def fives_fail(rows):
        asked.append(len(rows) // 3)
        if (rows["chatlog_id"] % 10 == 5).any():
            raise OSError("no fives")
        return verdicts.offline(rows)

    m = pd.DataFrame([(i, 0, f"loop {i}") for i in range(512)], columns=["chatlog_id", "message_index", "text"])
    out = pd.concat(labeling._in_calls(iter([m.iloc[:256], m.iloc[256:]]), pd.DataFrame(LOOPS, columns=["label", "cues"]), fives_fail, 1, 0, 4, "", (), lambda name, n: None))
    assert out["chatlog_id"].tolist() == list(range(512)) and out[out["error"].notna()]["chatlog_id"].tolist() == list(range(5, 512, 10))
    assert all(r["labels"] == {"loops": True, "tens": "1" in str(r["chatlog_id"])} for r in out[out["error"].isna()].to_dict("records"))
    # the provider is asked for four messages at once, or for one; the frames that it is given from are few
    assert set(asked) == {1, 4} and len(asked) > 128 and frames == [256, 256]


def test_a_run_that_is_cut_keeps_finished_tasks_and_shows_them(spark, tmp_path):
    m, labels = many(spark, 48)
    path, gate, seen = str(tmp_path / "v"), str(tmp_path / "gate"), []

    def waiting(rows):
        if (rows["chatlog_id"] >= 40).any():
            while not os.path.exists(gate):
                time.sleep(0.1)
        return verdicts.offline(rows)

    def cut(counts):
        seen.append(counts["messages"])
        if counts["messages"] >= 8:
            spark.sparkContext.cancelAllJobs()

    with pytest.raises(Exception):
        labeling.label_messages(spark, m, labels, path, "s", waiting, each=2, a_task=2, on_progress=cut)
    open(gate, "w").close()
    had = {r["chatlog_id"] for r in labeling.stored(spark, path).collect()}
    assert len(had) >= 8 and len(had) < 48 and max(seen) < 48 and len(set(seen)) >= 1
    noted, asked = noting(str(tmp_path / "asked"))
    assert labeling.label_messages(spark, m, labels, path, "s", noted).count() == 48
    assert asked() == set(range(48)) - had


def test_counts_rise_while_a_run_goes_on(spark, tmp_path):
    m, labels = many(spark)

    def slow(rows):
        time.sleep(0.4)
        return verdicts.offline(rows)

    seen = []
    labeling.label_messages(spark, m, labels, str(tmp_path / "v"), "s", slow, each=2, a_task=4, on_progress=lambda c: seen.append(c["messages"]))
    assert seen == sorted(seen) and seen[-1] == 40 and any(0 < n < 40 for n in seen)


def test_requests_say_what_is_known(spark, tmp_path):
    turns_ = spark.createDataFrame([("c", 1, i, "student" if i % 2 == 0 else "tutor", f"text {i}", i // 2 if i % 2 == 0 else None, i * 60_000_000, "tutor" if i % 2 == 0 else "", "n") for i in range(5)], "conv_id string, chatlog_id bigint, turn_index int, role string, text string, student_index int, us bigint, mode string, notebook string")
    m = described(turns_, turns_, sequence=False)
    seen = str(tmp_path / "prompts")

    def reads(rows):
        with open(seen, "a") as out:
            out.writelines(json.dumps([int(i), k, p]) + "\n" for i, k, p in zip(rows["message_index"], rows["kind"], rows["prompt"], strict=True))
        return pd.DataFrame({"applies": True, "rationale": "", "evidence": "t", "forms": [["nudge", "odd"]] * len(rows), "concepts": [["loops", "x"]] * len(rows), "move": "odd", "no_label_fits": False, "note": "unasked"})

    labels = spark.createDataFrame([("asks", "about asking", "a question", "a greeting")], "label string, description string, positive_criteria string, negative_criteria string")
    rows = labeling.label_messages(spark, m, labels, str(tmp_path / "v"), "s", reads, course="Data", concepts=(("loops", "repeating"),)).collect()
    assert len(rows) == 3 and all((r["forms"], r["concepts"], r["move"], r["coverage_note"], r["evidence"]) == (["nudge"], ["loops"], "", "", {"asks": "t"}) for r in rows)
    said = {(i, k): p for i, k, p in map(json.loads, open(seen))}
    assert len(said) == 6 and "asks: about asking" in said[2, "label"] and "It applies when: a question" in said[2, "label"] and "Course: Data" in said[2, "coverage"] and "- loops: repeating" in said[2, "coverage"]
    for kind in ("label", "coverage"):
        assert "student: text 0\ntutor: text 1" in said[2, kind] and "1 minutes (working)" not in said[2, kind] and "60 seconds (rapid)" in said[2, kind] and "Mode: tutor mode" in said[2, kind] and "Message:\ntext 2\nReply:\ntext 3" in said[2, kind]
        assert "(conversation start)" in said[0, kind] and said[4, kind].endswith("Reply:\n") and "No autograder data" in said[0, kind]


def test_votes_are_asked_at_a_temperature(spark):
    pairs = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], "chatlog_id bigint, message_index int, label string")

    def warm(rows):
        assert set(rows["temperature"]) == {0.7}
        return rows.assign(applies=rows["run"] % 2 == 0, rationale="", evidence="")

    got = verdicts.votes(pairs, warm).collect()
    assert len(got) == 10 and sum(r["applies"] for r in got) == 6 and {r["run"] for r in got} == set(range(5))


def test_audits_are_revealed_after_submission(spark, tmp_path):
    v = table(spark, {(1, 0): {"a"}, (2, 0): set()}).withColumn("rationale", F.lit("why"))
    sample = spark.createDataFrame([(1, 0), (2, 0)], "chatlog_id bigint, message_index int")
    seen = audit.payload(sample, sample.withColumn("text", F.lit("t")).withColumn("stratum", F.lit("s")))
    assert seen.columns == ["chatlog_id", "message_index", "text"] and seen.count() == 2
    with pytest.raises(audit.NotSubmitted):
        audit.reveal(spark, sample, v, str(tmp_path), "ann")
    answers = spark.createDataFrame([(1, 0, "a", True), (1, 0, "b", False)], "chatlog_id bigint, message_index int, label string, applies boolean")
    path = audit.submit(spark, answers, str(tmp_path), "ann")
    assert snapshot.read_audit(spark, path).count() == 2
    with pytest.raises(Exception):
        audit.submit(spark, answers, str(tmp_path), "ann")
    with pytest.raises(ValueError, match="more than 20000 messages"):
        audit.submit(spark, spark.range(20_001).selectExpr("id AS chatlog_id", "0 AS message_index", "'a' AS label", "true AS applies"), str(tmp_path), "bob")
    shown = {r["chatlog_id"]: [a["label"] for a in r["applied"]] for r in audit.reveal(spark, sample, v, str(tmp_path), "ann").collect()}
    assert shown == {1: ["a"], 2: []}


def test_retries():
    waits, calls = [], []

    def flaky(rows):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return rows

    assert verdicts.with_retries(flaky, 5, sleep=waits.append) == 5 and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        verdicts.with_retries(lambda _: (_ for _ in ()).throw(OSError()), None, attempts=2, sleep=waits.append)


def test_facets_and_ablations(spark):
    df = spark.sql("SELECT array('nudge', 'odd', 'other', 'nudge') AS forms, array('c1', 'c9') AS concepts, 'jumps' AS move, 'note' AS coverage_note, false AS no_label_fits")
    r = verdicts.filtered_facets(df, ["c1"]).collect()[0]
    assert (r["forms"], r["concepts"], r["move"], r["coverage_note"]) == (["nudge", "other", "nudge"], ["c1"], "", "")
    m = spark.sql("SELECT array(struct('tutor' AS role, 'x' AS text)) AS context, 'y' AS context_after, 'ask-first' AS pre_pattern, true AS snapshot_traceback")
    assert verdicts.without_context(m).collect()[0]["context"] == [] and verdicts.without_sequence(m).collect()[0]["pre_pattern"] == ""


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    make = lambda **t: snapshot.emit(spark, str(tmp_path), "s", t, {"labels": []}, {"schema_version": "v"})
    first, second = make(rows=df), make(rows=df)
    assert first.endswith("/s") and second.endswith("/s-2")
    assert snapshot.read_json_file(spark, f"{first}/manifest.json")["row_counts"] == {"rows": 2}
    broken = df.select(F.raise_error(F.lit("no")).cast("string").alias("z"))
    with pytest.raises(Exception):
        make(rows=df, broken=broken)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s", "s-2"]


def test_old_label_files_get_defaults(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text(json.dumps({"chatlog_id": 1, "message_index": 2, "labels": {"a": True}}) + "\n")
    r = snapshot.read_labels(spark, str(tmp_path / "labels.jsonl")).collect()[0]
    assert r["labels"] == {"a": True} and r["forms"] == [] and r["mode"] == "" and r["no_label_fits"] is False and r["attempted"] is None
    row = {"chatlog_id": 1, "message_index": 0, "labels": {"a": True, "b": False}}
    for name, value in (("one.json", [row]), ("two.json", {"rows": [row], "strata": {}})):
        (tmp_path / name).write_text(json.dumps(value))
        assert snapshot.read_audit(spark, str(tmp_path / name)).count() == 2


def test_materials(spark, tmp_path):
    (tmp_path / "m.txt").write_text("x" * 30)
    assert snapshot.read_materials(spark, str(tmp_path / "m.txt"), 20).collect()[0]["text"] == "x" * 20


def a_log(spark):
    rows = [(i, i * 1000, "u", "tutor_query" if i % 2 == 0 else "tutor_response", f"c{i // 6}", "n", f"loop {i}" if i % 2 == 0 else None, "ok" if i % 2 else None, "tutor") for i in range(24)]
    return spark.createDataFrame(rows, "event_id bigint, us bigint, user_key string, event_type string, conv_id string, notebook string, question string, response string, mode string")


def test_a_session_works_out_each_message_once(spark, tmp_path, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), session.described

    def counting(*args):
        counted = F.udf(lambda shown: made.add(1) or shown).asNondeterministic()
        return real(*args).withColumn("shown", counted("shown"))

    monkeypatch.setattr(session, "described", counting)
    s = Session(spark, a_log(spark), str(tmp_path), lambda intent, digest: (Label("loops", cues="loop"),))
    s.start("what is hard")
    s.review(3).count()
    assert made.value == 12
    s.accept()
    assert made.value == 24


def test_session(spark, tmp_path):
    s = Session(spark, a_log(spark), str(tmp_path), lambda intent, digest: (Label("loops", cues="loop"),))
    with pytest.raises(PhaseError):
        s.accept()
    s.start("what is hard")
    noted, asked = noting(str(tmp_path / "asked"))
    s.provider = noted
    shown = s.review(3).collect()
    assert s.phase == "review" and len(shown) == 3 and all(r["applied"][0]["label"] == "loops" and r["stratum"] for r in shown) and len(asked()) <= 3
    before = s.schema.version
    s.tweak((Label("loops", cues="loop"), Label("tens", cues="1")))
    assert s.schema.parent_version == before
    path = s.accept()
    counts = snapshot.read_json_file(spark, f"{path}/manifest.json")["row_counts"]
    assert s.phase == "done" and counts == {"conversations": 4, "labels": 12}
    rows = snapshot.read_labels(spark, f"{path}/labels.jsonl").collect()
    assert len(rows) == 12 and all(r["labels"]["loops"] and r["forms"] == ["nudge"] and r["latency_bucket"] and r["mode"] == "tutor" and r["attempted"] is None for r in rows)
    assert {r["label"]: r["n"] for r in s.summary().collect()}["loops"] == 12 and s.examples("loops", 99).count() == 12
    assert s.abstentions().collect()[0]["abstained"] == 0 and s.abstained().count() == 0
    s.back_to_review()
    # a provider that fails once: what it finished stays, and a retry asks for the rest
    def away(rows):
        raise OSError("away")

    s.tweak((Label("fives", cues="5"),))
    s.provider, s.wait_seconds = away, 0
    with pytest.raises(labeling.LabelingError):
        s.accept()
    assert s.phase == "error" and "away" in s.error and s.counts["failed"] > 0
    s.provider = verdicts.offline
    s.retry()
    assert s.phase == "done" and s.counts["messages"] == 12 and s.error == ""
    # the classifier is another with other labels, so no verdict of the first is counted
    assert s.abstentions().collect()[0]["abstained"] == 12 and s.abstained(2).count() == 2 and "none of the cues" in s.abstained(1).collect()[0]["coverage_note"]
    s.quit()
    assert s.phase == "idle"
    failing = Session(spark, a_log(spark), str(tmp_path / "x"), lambda intent, digest: (Label("x", "w " * 30),))
    with pytest.raises(ValueError):
        failing.start("x")
    assert failing.phase == "error" and failing.error


def test_a_session_samples_by_stratum_and_knows_of_runs(spark, tmp_path):
    talk = [(i, i * 60_000_000, "u", "tutor_query", f"c{i}", "n", f"q1_{i} loop", None, "tutor", None, None, None) for i in range(6)]
    runs = [(100 + i, i * 60_000_000 - 1, "u", "autograder_info", None, "n", None, None, None, f"q1_{i}", "false" if i % 2 else "true", None) for i in range(6)]
    schema = "event_id bigint, us bigint, user_key string, event_type string, conv_id string, notebook string, question string, response string, mode string, grader_id string, success string, notebook_json string"
    s = Session(spark, spark.createDataFrame(talk + runs, schema), str(tmp_path), lambda intent, digest: (Label("loops", cues="loop"),))
    s.start("x")
    assert {r["stratum"] for r in s.review(6).collect()} > {"short conversation · early/seq-fail"} or s.messages().select("stratum").distinct().count() >= 2
    rows = snapshot.read_labels(spark, f"{s.accept()}/labels.jsonl").collect()
    assert {r["pre_pattern"] for r in rows} == {"fail-then-ask", "pass-then-ask"} and all(r["attempted"] and r["seq_granularity"] == "question" and r["question_ref"].startswith("q1_") for r in rows)
    with_runs = s.classifier
    s.sequence = False
    assert s.classifier != with_runs


def test_profiles_are_reviewed(spark, tmp_path):
    found = Profile("c", (Concept("loops", "repeating"), Concept("plots"), Concept("odd")), (Label("sad"),), (Label("asks"),))
    s = Session(spark, a_log(spark), str(tmp_path), lambda intent, digest: (Label("own", cues="loop"),))
    with pytest.raises(PhaseError):
        s.accept_profile()
    assert s.peek(99).count() == 12 and s.peek(0).count() == 1 and "stratum" in s.peek().columns and s.phase == "idle"
    s.explore(lambda digest, materials: found)
    assert s.phase == "profile_review" and s.profile is None
    with pytest.raises(ValueError, match="collision"):
        s.profile_draft = Profile("c", (Concept("sad"),), (Label("sad"),))
        s.accept_profile(promoted=["sad"])
    s.profile_draft = found
    got = s.accept_profile({"concepts": ["odd"]}, ["loops"])
    saved = list((tmp_path / "profiles").glob("*.json"))
    assert len(saved) == 1 and Profile.load(spark, str(saved[0])) == got and got.taught() == (("plots", ""),)
    assert s.phase == "idle" and got.accepted and [x.name for x in got.layers()] == ["loops", "sad", "asks"] and "loops (repeating)" in got.layers()[0].positive_criteria
    s.start("x")
    s.accept()
    assert [x.name for x in s.schema.labels] == ["own", "loops", "sad", "asks"] and s.schema.parent_version
    # a profile that breaks the caps is asked for once more
    said, long = [], Profile("c", (Concept("x", "w " * 21),), (Label("y", positive_criteria="w " * 26),))
    s.quit()
    s.explore(lambda digest, materials: said.append(digest) or (long if len(said) == 1 else found))
    assert len(said) == 2 and said[1].endswith("Keep every field short.") and s.phase == "profile_review" and len(long.oversized()) == 2
    s.discard_profile()
    with pytest.raises(ValueError, match="x.description .21w > 20w."):
        s.explore(lambda digest, materials: long)
    with pytest.raises(ValueError, match="more than 50 files"):
        Session(spark, a_log(spark), str(tmp_path), s.draft).explore(lambda digest, materials: found, spark.range(51).selectExpr("CAST(id AS STRING) AS path", "'t' AS text"))
    # a profile that quotes a student is refused, and so is one whose exploration fails
    said = [(i, i, "u", "tutor_query", "c", "n", "i really do not know how to group this table", None, "tutor") for i in range(2)]
    quoting = Session(spark, spark.createDataFrame(said, a_log(spark).schema), str(tmp_path / "q"), s.draft)
    with pytest.raises(ValueError, match="quotes"):
        quoting.explore(lambda digest, materials: Profile("c", (Concept("x", "they really do not know how to group this table"),)))
    assert quoting.phase == "error"
    with pytest.raises(ValueError):
        quoting.retry()
    clash = Session(spark, a_log(spark), str(tmp_path / "z"), lambda intent, digest: (Label("sad", cues="loop"),), profile=got)
    clash.start("x")
    with pytest.raises(ValueError, match="collision"):
        clash.accept()
    clash.quit()
    clash.discard_profile()
    assert clash.profile is None


def test_stream_labels_each_message_once(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "chatlog_id bigint, message_index int, text string, us bigint"
    labels = spark.createDataFrame([("loops", "loop")], "label string, cues string")
    for part in ([(1, 0, "loop", 10), (1, 0, "loop", 10)], [(1, 0, "loop", 10), (2, 0, "x", 20)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        label_stream(spark, spark.readStream.schema(schema).parquet(src), labels, str(tmp_path / "out"), str(tmp_path / "cp"), "v").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    # a message first seen ten days late, one that comes again, and one without a time
    day = 86_400_000_000
    for part in ([(3, 0, "loop", 30 * day)], [(4, 0, "loop", 20 * day), (3, 0, "loop", 5 * day), (5, 0, "x", None)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        label_stream(spark, spark.readStream.schema(schema).parquet(src), labels, str(tmp_path / "out"), str(tmp_path / "cp"), "v").awaitTermination(120)
    assert sorted(r["chatlog_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5]


def test_parse(spark):
    raw = spark.createDataFrame([(1, "tutor_query", "2024-01-01 00:00:01", "u", json.dumps({"conversation_id": "c", "question": "q", "success": True}))], "id bigint, event_type string, created_at string, user_email string, payload string")
    r = events.parse(raw).collect()[0]
    assert (r["us"], r["conv_id"], r["question"], r["success"], r["mode"]) == (1704067201000000, "c", "q", "true", None)
