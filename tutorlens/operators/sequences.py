"""Test runs around conversations: as-of and range joins on (user, notebook)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MINUTE = 60_000_000
RUN = "struct<run_us:bigint,run_id:bigint,grader_id:string,run_success:boolean>"


def brackets(log: DataFrame) -> DataFrame:
    """One row per (conv_id, user, notebook) with student queries: first and last query time and their number."""
    asked = log.filter((F.col("event_type") == "tutor_query") & F.col("user_key").isNotNull() & F.col("notebook").isNotNull())
    return asked.groupBy("conv_id", "user_key", "notebook").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.count("*").alias("n_messages"))


def runs(log: DataFrame) -> DataFrame:
    return log.filter("event_type = 'autograder_info'").select(F.col("user_key").alias("run_user"), F.col("notebook").alias("run_notebook"), F.col("us").alias("run_us"), F.col("event_id").alias("run_id"), "grader_id", "success")


def _in_range(before: int, after: int) -> Column:
    return F.col("run_us").between(F.col("t0") - before * MINUTE, F.col("t1") + after * MINUTE)


def around(convs: DataFrame, found: DataFrame, before: int, after: int, how: str = "inner") -> DataFrame:
    """Brackets with the runs of their user and notebook from `before` minutes before to `after` minutes behind them.

    Both sides are cut into buckets of time as long as the window, and meet on (user, notebook,
    bucket): a bracket is in two buckets and one more for each length that it lasts, a run in one,
    so a user with very many runs is spread over time and nobody's runs meet all of their brackets.
    With how="left" a bracket without runs in a bucket has a row of nulls there.
    """
    width = max(1, before + after) * MINUTE
    bucket = lambda us: F.floor(us / width)
    spans = F.sequence(bucket(F.col("t0") - before * MINUTE), bucket(F.col("t1") + after * MINUTE))
    left = convs.withColumn("__bucket", F.explode_outer(spans))
    right = found.withColumn("__run_bucket", bucket(F.col("run_us")))
    same = (F.col("user_key") == F.col("run_user")) & (F.col("notebook") == F.col("run_notebook")) & (F.col("__bucket") == F.col("__run_bucket"))
    return left.join(right, same & _in_range(before, after), how).drop("__bucket", "__run_bucket")


def classify(last_before: Column, passed_after: Column, any_after: Column) -> tuple[Column, Column]:
    """Pattern before and outcome after: a missing last run is ask-first, any value but 'false' a pass."""
    pre = F.when(last_before.isNull(), "ask-first").when(last_before == "false", "fail-then-ask").otherwise("pass-then-ask")
    return pre, F.when(passed_after, "quick-pass").when(any_after, "fail-after").otherwise("no-run-after")


def distances(log: DataFrame, before: int, after: int) -> DataFrame:
    """(conv_id, user_key, notebook, n_messages, t0, t1, last, run_before, pass_after, run_after), one row per bracket.

    From one interval join: the latest run before the first query (`last` is its result, the newest
    event's between runs of one time), and the first passed run and the first run from the last
    query on; times in microseconds, null where there is none in the window.
    """
    met = around(brackets(log), runs(log), before, after, "left")
    early, late = F.col("run_us") <= F.col("t0"), F.col("run_us") >= F.col("t1")
    return met.groupBy("conv_id", "user_key", "notebook", "n_messages", "t0", "t1").agg(
        F.max_by(F.when(early, F.struct("success")), F.when(early, F.struct("run_us", "run_id"))).alias("last"),
        F.max(F.when(early, F.col("run_us"))).alias("run_before"),
        F.min(F.when(late & (F.col("success") == "true"), F.col("run_us"))).alias("pass_after"),
        F.min(F.when(late, F.col("run_us"))).alias("run_after"),
    )


def sequences(log: DataFrame, before: int, after: int) -> DataFrame:
    """(conv_id, user_key, notebook, n_messages, pre, outcome), one row per bracket."""
    d = distances(log, before, after)
    pre, outcome = classify(F.col("last.success"), F.col("pass_after").isNotNull(), F.col("run_after").isNotNull())
    return d.select("conv_id", "user_key", "notebook", "n_messages", pre.alias("pre"), outcome.alias("outcome"))


def window_sweep(log: DataFrame, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """(before_minutes, after_minutes, pre, outcome, n) for each window, classes without brackets left out.

    Runs are joined once, in the widest window; a narrower one has the same latest run before, if it
    is near enough, and the same first runs behind.
    """
    d = distances(log, max(b for b, _ in windows), max(a for _, a in windows))
    table = F.array(*[F.struct(F.lit(b).alias("before_minutes"), F.lit(a).alias("after_minutes")) for b, a in windows])
    each = d.withColumn("w", F.explode(table)).select("w.*", "last", "t0", "t1", "run_before", "pass_after", "run_after")
    near = F.col("run_before") >= F.col("t0") - F.col("before_minutes").cast("bigint") * MINUTE
    soon = lambda c: F.coalesce(F.col(c) <= F.col("t1") + F.col("after_minutes").cast("bigint") * MINUTE, F.lit(False))
    pre, outcome = classify(F.when(near, F.col("last.success")), soon("pass_after"), soon("run_after"))
    return each.groupBy("before_minutes", "after_minutes", pre.alias("pre"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def runs_before(log: DataFrame, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """(before_minutes, after_minutes, n, with_run_before): brackets, and those with a run of known result before them, for each window."""
    n = window_sweep(log, windows).groupBy("before_minutes", "after_minutes")
    return n.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("pre") != "ask-first", F.col("n"))), F.lit(0)).alias("with_run_before"))


def outcome_table(seqs: DataFrame) -> DataFrame:
    """How often each outcome follows each pattern, and its share of the pattern."""
    n = seqs.groupBy("pre", "outcome").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("pre")))


def bracket_runs(log: DataFrame, before: int, after: int) -> DataFrame:
    """(conv_id, run_us, run_id, grader_id, success) of every run with a known result in a bracket."""
    convs, found = brackets(log), runs(log).filter(F.col("success").isNotNull())
    met = around(convs, found, before, after)
    return met.select("conv_id", "run_us", "run_id", "grader_id", (F.col("success") == "true").alias("success"))


def traceback_flags(log: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, flag) for every conversation: whether a notebook snapshot shows a traceback; false where none was taken."""
    shot = log.filter((F.col("event_type") == "tutor_notebook_info") & F.col("notebook_json").isNotNull())
    flags = shot.groupBy("conv_id").agg(F.bool_or(F.contains("notebook_json", F.lit("Traceback"))).alias("f"))
    return conversations.select("conv_id").distinct().join(flags, "conv_id", "left").select("conv_id", F.coalesce("f", F.lit(False)).alias("flag"))


def message_facts(turns: DataFrame, found: DataFrame, flags: DataFrame, ref: Column) -> DataFrame:
    """Facts of each student turn: question reference, grain, and the last run up to it.

    If the reference has any matching run in the bracket, even a later one, only matching runs
    count; otherwise all of the notebook's do. A turn without a time asserts nothing about runs.
    Turns and runs are put in one order of time for each conversation and check, so each is read
    once and no turn meets all runs. (conv_id, turn_index) is a key of `turns`.
    """
    t = turns.filter("role = 'student'").withColumn("question_ref", ref)
    none = F.lit(None)
    asked = t.select("conv_id", F.explode(F.array_distinct(F.array(F.lit(""), "question_ref"))).alias("scope"), "us", F.lit(1).alias("asks"), "turn_index", none.cast(RUN).alias("run"))
    # a run is one of its notebook, of its own check, and of every check that this one is part of
    parts = F.split("grader_id", "_")
    named = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    scopes = F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.col("grader_id").isNotNull(), named).otherwise(F.array().cast("array<string>"))))
    run = F.struct("run_us", "run_id", "grader_id", F.col("success").alias("run_success")).cast(RUN)
    ran = found.select("conv_id", F.explode(scopes).alias("scope"), F.col("run_us").alias("us"), F.lit(0).alias("asks"), none.cast("int").alias("turn_index"), run.alias("run"))
    # texts stay out of this; windows and groups below are all within a conversation, which is dealt out once
    both = asked.withColumn("turn_index", F.col("turn_index").cast("int")).unionByName(ran).repartition("conv_id")
    whole = Window.partitionBy("conv_id", "scope")
    upto = whole.orderBy(F.asc_nulls_first("us"), "asks", "run").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("run", ignorenulls=True).over(upto)).withColumn("any", F.max(F.col("asks") == 0).over(whole)).filter("asks = 1")
    own = F.col("scope") != ""
    placed = seen.groupBy("conv_id", "turn_index").agg(
        F.coalesce(F.max(F.when(own, F.col("any"))), F.lit(False)).alias("scoped"),
        F.max(F.when(own, F.col("last"))).alias("last_scoped"), F.max(F.when(~own, F.col("last"))).alias("last_any"),
    )
    out = t.join(flags, "conv_id", "left").join(placed, ["conv_id", "turn_index"])
    out = out.withColumn("last", F.when(F.col("scoped"), F.col("last_scoped")).otherwise(F.col("last_any")))
    timed = F.col("us").isNotNull()
    pre = F.when(~timed, "").when(F.col("last").isNull(), "ask-first").when(F.col("last.run_success"), "pass-then-ask").otherwise("fail-then-ask")
    out = out.withColumns({
        "snapshot_traceback": F.coalesce("flag", F.lit(False)),
        "seq_granularity": F.when(F.col("scoped"), "question").otherwise("notebook"),
        "pre_pattern": pre,
        "last_run_minutes": F.when(timed, (F.col("us") - F.col("last.run_us")) / float(MINUTE)),
        "last_run_grader": F.when(timed, F.coalesce("last.grader_id", F.lit(""))).otherwise(""),
        "last_run_success": F.when(timed, F.col("last.run_success")),
    })
    known = F.col("pre_pattern") != ""
    return out.withColumns({
        "attempted": F.when(known, F.col("pre_pattern") != "ask-first"),
        "error_verified": F.when(known, F.col("snapshot_traceback") | F.coalesce(~F.col("last_run_success"), F.lit(False))),
    }).drop("flag", "scoped", "last_scoped", "last_any", "last")


def stratum(tercile: Column, position: Column, pre: Column, defected: Column) -> Column:
    suffix = F.when(pre == "fail-then-ask", "/seq-fail").when(pre == "ask-first", "/seq-askfirst").when(defected, "/seq-defect").otherwise("")
    return F.concat(tercile, F.lit("/"), position, suffix)
