"""Turns, sequences and facts against values worked out by hand."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tutorlens.functions import text as T
from tutorlens.operators import clusters, sampling, sequences, sketches, trajectories, turns
from tutorlens.operators.components import components
from tutorlens.sources import events as E
from tutorlens.streaming import sessions
from tutorlens.streaming.turns import turns_as_they_arrive

MIN, SEC = 60_000_000, 1_000_000
LOG = "event_id bigint, us bigint, user_key string, event_type string, conv_id string, notebook string, question string, response string, mode string, grader_id string, success string, notebook_json string"


def log(spark, rows):
    names = [c.split()[0] for c in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG)


def ask(i, us, q="help", conv="c", mode="tutor", user="u", nb="n"):
    return {"event_id": i, "us": us, "user_key": user, "event_type": "tutor_query", "conv_id": conv, "notebook": nb, "question": q, "mode": mode}


def tell(i, us, r="reply", conv="c", user="u", nb="n"):
    return {"event_id": i, "us": us, "user_key": user, "event_type": "tutor_response", "conv_id": conv, "notebook": nb, "response": r}


def run(i, us, ok, grader="q1_1", user="u", nb="n"):
    return {"event_id": i, "us": us, "user_key": user, "event_type": "autograder_info", "notebook": nb, "grader_id": grader, "success": ok}


def chat(spark, marks):
    """Turns (role, us, mode) of one conversation."""
    rows = [("c", 0, i, r, f"{r[0]}{i}", us, mode) for i, (r, us, mode) in enumerate(marks)]
    return spark.createDataFrame(rows, "conv_id string, chatlog_id bigint, turn_index int, role string, text string, us bigint, mode string")


def test_assemble_turns(spark):
    rows = [tell(1, 1), ask(2, 2, "first"), tell(3, 3, "answer"), ask(4, 4, "second", mode=None), ask(5, 5, ""), tell(6, 6, None)]
    got = [(r["turn_index"], r["role"], r["text"], r["student_index"], r["mode"], r["chatlog_id"]) for r in E.assemble_turns(log(spark, rows)).orderBy("turn_index").collect()]
    assert got == [(0, "student", "first", 0, "tutor", 1), (1, "tutor", "answer", None, "", 1), (2, "student", "second", 1, "", 1)]


def test_heads_and_windows(spark):
    df = log(spark, [ask(1, 10, conv="a"), ask(2, 20, conv="b"), tell(3, 5, conv="b"), ask(4, 40, conv=None), run(5, 1, "true")])
    got = {r["conv_id"]: (r["chatlog_id"], r["started_us"]) for r in E.heads(df).collect()}
    assert got == {"a": (1, 10), "b": (2, 5), None: (4, 40)}
    assert {r["conv_id"] for r in E.heads(df, 5, 10).collect()} == {"b"}
    assert E.conversation_count(df).collect()[0][0] == 2
    with pytest.raises(ValueError):
        E.heads(df, since=1)
    heads, found = E.fetch(df, limit=2)
    assert {r["conv_id"] for r in heads.collect()} == {"a", "b"}
    # the head without a conversation takes a place and then has no turns
    assert E.fetch(df, limit=3)[0].count() == 2 and E.sampled_heads(E.heads(df), 2, 1).count() == 2


def test_context(spark):
    t = chat(spark, [(("student", "tutor")[i % 2], i, "") for i in range(16)])
    rows = {r["turn_index"]: r for r in turns.with_context(t).collect()}
    assert rows[0]["context"] == [] and [c["text"] for c in rows[14]["context"]] == ["s8", "t9", "s10", "t11", "s12", "t13"]
    assert rows[14]["context_after"] == "t15" and rows[15]["context_after"] is None and rows[13]["context_after"] == "t15"


def test_latency(spark):
    waits = [0, 119, 121, 29 * 60, 31 * 60, 7 * 3600, None]
    marks = [("student", 0, ""), ("tutor", SEC, "")] + [("student", None if w is None else SEC + w * SEC, "") for w in waits]
    got = [r["latency_bucket"] for r in turns.with_latency(chat(spark, marks)).orderBy("turn_index").collect()]
    assert got[0] == "conversation-opening" and got[2:] == ["rapid", "rapid", "working", "working", "delayed", "returned", "unknown"]
    # the nearest tutor turn counts even without a time
    blind = turns.with_latency(chat(spark, [("tutor", 5, ""), ("tutor", None, ""), ("student", 9, "")])).orderBy("turn_index").collect()[2]
    assert blind["latency_seconds"] is None and blind["latency_bucket"] == "unknown"


def test_defections(spark):
    on = lambda modes: [r["turn_index"] for r in turns.with_defection(chat(spark, [("student", i, m) for i, m in enumerate(modes)])).filter("defected").orderBy("turn_index").collect()]
    assert on(["tutor", "tutor", "chatgpt", "chatgpt"]) == [2]
    assert on(["chatgpt", "tutor"]) == []
    assert on(["tutor", "", "chatgpt", "tutor", "chatgpt"]) == [2, 4]


def test_terciles(spark):
    sizes = [1, 2, 4, 6, 9, 12, 13, 14, 15, 16]
    rows = [(f"c{k:02}", k, i, "student") for k, n in enumerate(sizes) for i in range(n)]
    got = {r["conv_id"]: r["tercile"] for r in turns.length_terciles(spark.createDataFrame(rows, "conv_id string, chatlog_id bigint, turn_index int, role string")).collect()}
    assert [got[f"c{k:02}"] for k in range(10)] == ["short"] * 3 + ["mid"] * 3 + ["long"] * 4


def test_weeks_are_elapsed_days(spark):
    day = 86_400_000_000
    df = spark.createDataFrame([(1, day // 2), (2, day // 2 + 7 * day - 1), (3, day // 2 + 7 * day), (4, None)], "chatlog_id bigint, started_us bigint")
    assert {r["chatlog_id"]: r["week"] for r in turns.conversation_weeks(df).collect()} == {1: 0, 2: 0, 3: 1, 4: None}


def test_sequences(spark):
    t0 = 100 * MIN
    rows = [ask(1, t0), ask(2, t0 + MIN)]

    def one(*more):
        r = sequences.sequences(log(spark, [*rows, *more]), 45, 20).collect()
        assert len(r) == 1
        return r[0]["pre"], r[0]["outcome"]

    assert one() == ("ask-first", "no-run-after")
    assert one(run(3, t0 - 45 * MIN, "false"), run(4, t0 + 21 * MIN, "true")) == ("fail-then-ask", "quick-pass")
    assert one(run(3, t0 - 45 * MIN - 1, "false")) == ("ask-first", "no-run-after")
    assert one(run(3, t0 - 2, "false"), run(4, t0 - 1, "true"), run(5, t0 + 2 * MIN, "false")) == ("pass-then-ask", "fail-after")
    assert one(run(3, t0 - 1, None), run(5, t0 + 21 * MIN + 1, "true")) == ("ask-first", "no-run-after")
    assert one(run(3, t0 - 1, "true", nb="other"), run(4, t0 - 1, "true", user="v")) == ("ask-first", "no-run-after")


def test_one_row_per_conversation_user_and_notebook(spark):
    rows = [ask(1, 1), ask(2, 2, user="v"), ask(3, 3, nb="m")]
    assert sequences.sequences(log(spark, rows), 45, 20).count() == 3


def test_traceback_flags(spark):
    shot = lambda i, c, j: {"event_id": i, "event_type": "tutor_notebook_info", "conv_id": c, "notebook_json": j}
    df = log(spark, [shot(1, "a", "x Traceback y"), shot(2, "a", "ok"), shot(3, "b", "traceback"), shot(4, "b", None)])
    convs = spark.createDataFrame([("a",), ("b",), ("z",)], "conv_id string")
    assert {r["conv_id"]: r["flag"] for r in sequences.traceback_flags(df, convs).collect()} == {"a": True, "b": False, "z": False}


def facts(spark, text, us, runs):
    t = spark.createDataFrame([("c", 0, 0, "student", text, us, "tutor")], "conv_id string, chatlog_id bigint, turn_index int, role string, text string, us bigint, mode string")
    r = spark.createDataFrame([("c", *x) for x in runs], "conv_id string, run_us bigint, run_id bigint, grader_id string, success boolean")
    flags = spark.createDataFrame([("c", True)], "conv_id string, flag boolean")
    return sequences.message_facts(t, r, flags, T.question_ref(F.col("text"))).collect()[0]


def test_message_facts(spark):
    now = 100 * MIN
    f = facts(spark, "q1_1 keeps failing", now, [(now - 4 * MIN, 1, "q1_10", True), (now - 3 * MIN, 2, "q1_1_2", False)])
    assert (f["pre_pattern"], f["last_run_grader"], f["seq_granularity"], f["last_run_minutes"]) == ("fail-then-ask", "q1_1_2", "question", 3.0)
    assert f["attempted"] and f["error_verified"]
    f = facts(spark, "q1_1 keeps failing", now, [(now - 4 * MIN, 1, "q9", True)])
    assert (f["pre_pattern"], f["seq_granularity"]) == ("pass-then-ask", "notebook")
    # a matching run that comes later still narrows the scope
    f = facts(spark, "q1_1 keeps failing", now, [(now - MIN, 1, "q9", True), (now + MIN, 2, "q1_1", True)])
    assert (f["pre_pattern"], f["seq_granularity"], f["last_run_success"]) == ("ask-first", "question", None) and f["attempted"] is False
    f = facts(spark, "hm", None, [(now, 1, "q9", True)])
    assert f["pre_pattern"] == "" and f["last_run_minutes"] is None and f["attempted"] is None and f["snapshot_traceback"]


def test_question_refs(spark):
    cases = {"how do I do 3.2?": "q3_2", "stuck on question 4": "q4", "q1_10 keeps failing": "q1_10", "Q2.4.1 hint please": "q2_4_1", "in 1.5.2 I see": "q1_5_2", "my groupby is broken": "", "version 3.2 of pandas": "q3_2", "éq3": "", "": ""}
    df = spark.createDataFrame(list(cases.items()), "text string, want string").withColumn("got", T.question_ref(F.col("text")))
    assert df.filter("got <> want").collect() == []
    assert spark.createDataFrame([(None,)], "text string").select(T.question_ref(F.col("text"))).collect()[0][0] == ""


def test_strata(spark):
    df = spark.createDataFrame([("short", "early", "fail-then-ask", True), ("mid", "late", "ask-first", True), ("long", "late", "pass-then-ask", True), ("long", "late", "", False)], "t string, p string, pre string, d boolean")
    got = [r[0] for r in df.select(sequences.stratum(F.col("t"), F.col("p"), F.col("pre"), F.col("d"))).collect()]
    assert got == ["short/early/seq-fail", "mid/late/seq-askfirst", "long/late/seq-defect", "long/late"]
    said = [r[0] for r in spark.createDataFrame([("short/early",), ("mid/late/seq-fail",), ("odd",)], "s string").select(T.plain_stratum(F.col("s"))).collect()]
    assert said == ["short conversation · early turn", "medium conversation · late/seq-fail", "odd · "]


def test_renderings(spark):
    df = spark.createDataFrame([(30.5, "rapid"), (7199.0, "delayed"), (7200.0, "delayed"), (172800.0, "returned"), (None, "unknown"), (None, "conversation-opening")], "s double, b string")
    got = [r[0] for r in df.select(T.render_latency(F.col("s"), F.col("b"))).collect()]
    assert got == ["30 seconds (rapid)", "120 minutes (delayed)", "2 hours (delayed)", "2 days (returned)", "(unknown)", "(conversation opening)"]
    df = spark.createDataFrame([("", "", None, None, "", True), ("ask-first", "notebook", None, None, "", False), ("fail-then-ask", "question", 2.5, False, "", True), ("pass-then-ask", "notebook", None, True, "q1", False)], "pre string, g string, m double, ok boolean, gr string, t boolean")
    got = [r[0] for r in df.select(T.render_sequence(*[F.col(c) for c in ("pre", "g", "m", "ok", "gr", "t")])).collect()]
    assert got[0] == "No autograder data for this conversation." and got[1] == "No autograder activity in the 45 min before this message (notebook-level)"
    assert got[2] == "last run 2m before this message: FAILED (unknown check, question-level); notebook snapshot at conversation start showed a traceback"
    assert got[3] == "last run ? before this message: PASSED (q1, notebook-level)"


def test_round_robin_is_the_same_at_any_partitioning(spark):
    rows = spark.createDataFrame([(i, 0, "abc"[min(i % 7, 2)]) for i in range(60)], "chatlog_id bigint, message_index int, stratum string")
    pick = lambda df: [tuple(r) for r in sampling.round_robin(df, 20, 3).collect()]
    one = pick(rows.coalesce(1))
    assert sorted(one) == sorted(pick(rows.repartition(16))) and len(set(one)) == 20
    counts = {s: sum(r[2] == s for r in one) for s in "abc"}
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sampling.round_robin(rows, None, 3).count() == 60 and sampling.round_robin(rows, 1000, 3).count() == 60


def test_jdbc_is_read_in_ranges_with_filters_pushed(spark, monkeypatch, tmp_path):
    """Against an embedded database: ranges of ids, bounds asked for where none are given, kinds filtered there."""
    url, driver = "jdbc:derby:memory:events;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    kinds = ["tutor_query", "tutor_response", "session_start"]
    raw = spark.createDataFrame([(i, kinds[i % 3], f"u{i % 4}", "{}") for i in range(90)], "ID bigint, EVENT_TYPE string, USER_EMAIL string, PAYLOAD string")
    try:
        raw.write.format("jdbc").options(url=url, dbtable="EVENTS", driver=driver, createTableColumnTypes="EVENT_TYPE VARCHAR(40), USER_EMAIL VARCHAR(40)").mode("overwrite").save()
    except Exception as missing:
        pytest.skip(f"no embedded database: {str(missing)[:80]}")
    with pytest.raises(ValueError):
        E.read_jdbc(spark)
    monkeypatch.setenv("EVENTS_JDBC_URL", url)
    got = E.read_jdbc(spark, table="EVENTS", kinds=kinds[:2], partitions=4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 60
    plan = got.select("user_email")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*In(EVENT_TYPE" in plan and "PAYLOAD" not in plan.split("ReadSchema")[-1]
    assert E.read_jdbc(spark, url, "EVENTS", bounds=(0, 90), partitions=3, driver=driver).rdd.getNumPartitions() == 3


def random_log(spark, seed=0, n=400):
    """Queries, replies and runs of a few users; one user has two thirds of the runs, some of them at one time."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        user = "hot" if rng.random() < 0.66 else f"u{rng.randrange(3)}"
        us = rng.randrange(0, 600) * 60_000_000
        kind = rng.choice(["tutor_query", "tutor_response", "autograder_info", "autograder_info"])
        asked = rng.choice(["q1 please", "q1_1 fails", "question 1.2", "nothing", "q2_1", ""])
        rows.append((i, us, user, kind, f"{user}-{us // 9_000_000_000}", rng.choice(["n", "m"]), asked if kind == "tutor_query" else None, "r" if kind == "tutor_response" else None, "tutor", rng.choice(["q1", "q1_1", "q1_1_2", "q1_10", "q2_1", None]) if kind == "autograder_info" else None, rng.choice(["true", "false", None]) if kind == "autograder_info" else None, None))
    return rows, spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("before,after", [(45, 20), (300, 0), (0, 0)])
def test_interval_join_meets_every_run_once(spark, before, after):
    rows, log = random_log(spark)
    convs, minute = {}, sequences.MINUTE
    for r in rows:
        if r[3] == "tutor_query":
            convs.setdefault((r[4], r[2], r[5]), []).append(r[1])
    want = Counter()
    for (conv, user, notebook), times in convs.items():
        for r in rows:
            if r[3] == "autograder_info" and r[10] and (r[2], r[5]) == (user, notebook) and min(times) - before * minute <= r[1] <= max(times) + after * minute:
                want[conv, r[1], r[0]] += 1
    got = Counter((r["conv_id"], r["run_us"], r["run_id"]) for r in sequences.bracket_runs(log, before, after).collect())
    assert got == want and (sum(want.values()) > 50 or before < 60)
    # sweeping windows at once is as good as one join for each
    windows = [(before, after), (before + 30, after + 200)]
    one = {}
    for b, a in windows:
        for r in sequences.sequences(log, b, a).groupBy("pre", "outcome").count().collect():
            one[b, a, r["pre"], r["outcome"]] = r["count"]
    assert {tuple(r)[:4]: r["n"] for r in sequences.window_sweep(log, windows).collect()} == one


def test_facts_of_a_turn_come_from_one_order(spark):
    _, log = random_log(spark, 3)
    found = sequences.bracket_runs(log, 120, 60)
    t = E.assemble_turns(log)
    flags = sequences.traceback_flags(log, t)
    got = sequences.message_facts(t, found, flags, T.question_ref(F.col("text"))).collect()
    by_conv = {}
    for r in found.collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert len(got) == t.filter("role = 'student'").count() > 50
    for r in got:
        own = by_conv.get(r["conv_id"], [])
        hits = [x for x in own if r["question_ref"] and x["grader_id"] and (x["grader_id"] == r["question_ref"] or x["grader_id"].startswith(r["question_ref"] + "_"))]
        pool = [x for x in (hits or own) if x["run_us"] <= r["us"]]
        last = max(pool, key=lambda x: (x["run_us"], x["run_id"]), default=None)
        assert r["seq_granularity"] == ("question" if hits else "notebook")
        assert r["pre_pattern"] == ("ask-first" if last is None else "pass-then-ask" if last["success"] else "fail-then-ask")
        assert r["last_run_grader"] == ((last["grader_id"] or "") if last else "")
    plan = sequences.message_facts(t, found, flags, T.question_ref(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    # runs are in the union, and meet turns in no join of their own
    assert plan.count("Union") == 1 and "run_us" not in "".join(line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Join") and "turn_index" in line)


def test_trajectories_group_around_archetypes(spark):
    rng, names = random.Random(7), ("a", "b", "c")
    kinds = {"x": "ababababab", "y": "ccccccccc", "z": "abcabcabc"}
    rows = []
    for i in range(60):
        kind = "xxyz"[i % 4]
        own = list(kinds[kind])
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = rng.choice("abc")
        rows += [(f"{kind}{i}", t, s) for t, s in enumerate(own)]
    rows += [("short", 0, "a"), ("gap", 0, "a"), ("gap", 1, None), ("gap", 2, "b"), ("odd", 0, "q"), ("odd", 1, "q")]
    states = spark.createDataFrame(rows, "conv_id string, turn_index int, state string")
    # plain Python: the same shares, then the same k-means over all conversations
    seqs = {}
    for c, t, s in rows:
        seqs.setdefault(c, []).append(s)
    vec = {}
    for c, own in seqs.items():
        steps = Counter((a, b) for a, b in zip(own, own[1:]) if a and b)
        n = sum(steps.values())
        if any(a in names and b in names for a, b in steps):
            vec[c] = tuple((2 * 10_000 * steps[a, b] + n) // (2 * n) for a in names for b in names)
    weight = Counter(vec.values())
    far = lambda v, cs: min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(cs))
    cs = [min(weight, key=lambda v: (-weight[v], v))]
    while len(cs) < 3:
        cs.append(min(weight, key=lambda v: (-weight[v] * far(v, cs)[0], v)))
    cs = [list(c) for c in cs]
    while True:
        of = {v: far(v, cs)[1] for v in weight}
        new = []
        for i, c in enumerate(cs):
            n = sum(w for v, w in weight.items() if of[v] == i)
            new.append([(2 * sum(v[j] * w for v, w in weight.items() if of[v] == i) + n) // (2 * n) for j in range(9)] if n else c)
        if new == cs:
            break
        cs = new
    members, table = trajectories.archetypes(trajectories.transitions(states), names, 3)
    got = {r["conv_id"]: r for r in members.collect()}
    assert set(got) == set(vec) and "gap" not in got and "short" not in got and "odd" not in got
    number = {r: far(vec[c], cs)[1] for c, r in ((c, got[c]["archetype"]) for c in vec)}
    assert all(number[got[c]["archetype"]] == far(vec[c], cs)[1] and got[c]["distance"] == far(vec[c], cs)[0] for c in vec)
    assert got["x0"]["archetype"] != got["y2"]["archetype"]
    rows = table.collect()
    sizes = {r["archetype"]: r["n"] for r in rows}
    assert len(rows) == 27 and [sizes[i] for i in sorted(sizes)] == sorted(sizes.values(), reverse=True) and sum(sizes.values()) == len(vec)
    assert all(got[r["example"]]["archetype"] == r["archetype"] for r in rows)
    again = trajectories.archetypes(trajectories.transitions(states.repartition(9)), names, 3)
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, members.collect())) and sorted(map(tuple, again[1].collect())) == sorted(map(tuple, rows))
    assert trajectories.archetypes(trajectories.transitions(states.limit(0)), names, 3)[0].count() == 0
    assert len({r["archetype"] for r in trajectories.archetypes(trajectories.transitions(states.filter("conv_id = 'y2'")), names, 3)[0].collect()}) == 1


def stream_of(spark, rows, folder, files, kind=LOG):
    """A stream that reads the rows, shuffled over so many files, one file a batch."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 8 * MIN))  # out of order by less than the delay
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def talk(n=300, seed=5):
    rng, out, us = random.Random(seed), [], 0
    for i in range(n):
        us += rng.randrange(1, 5 * MIN)
        asks = rng.random() < 0.5
        said = rng.choice(["text", "more", "", None])
        out.append((i, us, "u", "tutor_query" if asks else "tutor_response", f"c{rng.randrange(4)}", "n", said if asks else None, None if asks else said, rng.choice(["tutor", "chatgpt", "", None]) if asks else None, None, None, None))
    return out


def test_turns_arrive_as_the_batch_has_them(spark, tmp_path):
    rows = talk()
    last = rows[-1][1] + 10_000 * MIN
    end = [(9000 + k, last + k * MIN, "u", "tutor_query", "end", "n", "x", None, "tutor", None, None, None) for k in range(3)]
    log_ = stream_of(spark, rows + end, str(tmp_path / "in"), 6)
    turns_as_they_arrive(log_, "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(300)
    columns = ["conv_id", "chatlog_id", "turn_index", "role", "text", "student_index", "us", "mode", "event_id", "latency_seconds", "latency_bucket", "defected"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("conv_id <> 'end'").select(columns).collect())
    batch = turns.with_defection(turns.with_latency(E.assemble_turns(spark.createDataFrame(rows, LOG))))
    want = sorted(tuple(r) for r in batch.select(columns).collect())
    assert len(want) > 100 and got == want


def test_late_events_are_counted_and_sessions_agree(spark, tmp_path):
    rows = [(i, us * MIN, u, kind, "c", "n", "q", None, None, None, ok, None) for i, (us, u, kind, ok) in enumerate([(0, "u", "tutor_query", None), (20, "u", "autograder_info", "true"), (49, "u", "tutor_response", None), (90, "u", "tutor_query", None), (5, "v", "autograder_info", "false"), (36, "v", "tutor_query", None)])]
    by_hand = {("u", 0, 49, 3, 1, 1, 1), ("u", 90, 90, 1, 1, 0, 0), ("v", 5, 5, 1, 0, 1, 0), ("v", 36, 36, 1, 1, 0, 0)}
    plain = lambda df: {(r["user_key"], r["started_us"] // MIN, r["ended_us"] // MIN, *r[3:]) for r in df.collect()}
    log_ = spark.createDataFrame(rows, LOG)
    assert plain(sessions.study_sessions(log_, "30 minutes")) == by_hand
    assert sessions.study_sessions(log_.withColumn("us", F.lit(None).cast("bigint"))).count() == 0
    end = [(100, 100_000 * MIN, "w", "tutor_query", "c", "n", "q", None, None, None, None, None)]
    late = [(101, 10 * MIN, "u", "tutor_query", "c", "n", "q", None, None, None, None, None), (102, 200_000 * MIN, "w", "tutor_query", "c", "n", "q", None, None, None, None, None)]
    folder = str(tmp_path / "in")
    for part in (rows, end, late):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    query = sessions.study_sessions(stream, "30 minutes", "10 minutes").writeStream.format("memory").queryName("sessions_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert {r for r in plain(spark.table("sessions_test")) if r[0] != "w"} == by_hand and sessions.late_rows(query) == 1


def test_sketches_merge_within_their_errors(spark):
    rows = spark.range(60_000).select((F.col("id") % 9000).alias("chatlog_id"), (F.col("id") / 9000).cast("int").alias("message_index"), (F.col("id") % 4).alias("week"), F.when(F.col("id") % 5 > 0, F.col("id") % 1000).cast("double").alias("latency_seconds"))
    by_week = sketches.sketched(rows.unionByName(rows), "week").cache()
    assert by_week.count() == 4
    one = sketches.estimates(sketches.merged(by_week), 0.1, 0.5, 0.9).collect()[0]
    assert one["n"] == 120_000 and abs(one["n_messages"] - 60_000) <= sketches.COUNT_ERROR * 60_000 and abs(one["n_conversations"] - 9000) <= sketches.COUNT_ERROR * 9000
    assert all(abs(w - 1000 * r) <= 1000 * sketches.RANK_ERROR + 2 for w, r in zip(one["waits"], (0.1, 0.5, 0.9)))
    none = sketches.sketched(rows.withColumn("latency_seconds", F.lit(None).cast("double")), "week")
    assert sketches.estimates(sketches.merged(none), 0.5).collect()[0]["waits"] == [None] and sketches.estimates(by_week, 0.5).filter("week = 1").collect()[0]["waits"][0] is not None


def test_like_messages_are_a_cluster(spark):
    """Planted groups come out whole, thin places stay out, and equal texts and word order do not matter."""
    rng = random.Random(11)
    kinds = ["how do i merge two tables on a key column", "the kernel died again and my notebook is gone", "can you explain what a p value means here"]
    rows = []
    for i in range(90):
        words = kinds[i % 3].split()
        if i % 5 == 0:
            words[rng.randrange(len(words))] = f"odd{i}"
        if i % 7 == 0:
            rng.shuffle(words)
        rows.append((i, 0, " ".join(words).upper() if i % 11 == 0 else " ".join(words)))
    rows += [(200 + i, 0, f"alone {i} with words{i} of its{i} own{i}") for i in range(20)] + [(300, 0, None), (301, 0, ""), (302, 0, "?!")]
    m = spark.createDataFrame(rows, "chatlog_id bigint, message_index int, text string")
    members = clusters.clusters(m.repartition(5))
    got = {r["chatlog_id"]: r for r in members.collect()}
    assert len(got) == len(rows) and all(got[i]["cluster"] is None for i in got if i >= 200)
    names = [{got[i]["cluster"] for i in range(k, 90, 3)} for k in range(3)]
    assert all(len(n) == 1 for n in names) and len(set.union(*names)) == 3 and None not in set.union(*names)
    assert got[300]["text_id"] is None and got[302]["text_id"] is None
    told = {r["cluster"]: r for r in clusters.described(members, 2).collect()}
    assert {r["n_messages"] for r in told.values()} == {30} and all(len(r["examples"]) == 2 and r["n_texts"] < 30 for r in told.values())
    assert clusters.clusters(m.filter("chatlog_id < 0")).count() == 0 and clusters.clusters(m, least=31).filter("cluster IS NOT NULL").count() == 0


def test_components_of_the_core(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 3), (500 + 0, 501)] + [(501 + i, 502 + i) for i in range(30)]
    least = {x: x for pair in links if None not in pair and pair[0] != pair[1] for x in pair}
    for _ in range(60):
        for a, b in links:
            if a is not None and a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == least
