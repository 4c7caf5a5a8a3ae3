"""Every query of the library over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.functions import text as T
from tutorlens.operators import profile, quality, sampling, sequences, summary, turns
from tutorlens.params import Params
from tutorlens.plans import audit
from tutorlens.sources import events as E
from tutorlens.sources import testdata as D

#: Minutes before and after a conversation; the synthetic log is sparse, so its windows are wide.
BEFORE, AFTER = 1440, 720
#: Windows of the sweep: the library's own, and wider ones.
WINDOWS = ((45, 20), (720, 360), (1440, 720))
SEED = Params.seed
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


LOG = """WITH ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT event_id, us, user_id AS user_key, k, user_id || '-' || (us // 86400000000) AS conv_id, 'nb' || (user_id % 5) AS notebook,
  CASE event_type WHEN 'view' THEN 'tutor_query' WHEN 'click' THEN 'tutor_response' WHEN 'signup' THEN 'tutor_notebook_info' ELSE 'autograder_info' END AS event_type,
  CASE WHEN event_type <> 'view' THEN NULL WHEN k % 10 = 9 THEN '' WHEN k % 4 = 0 THEN 'q' || (k % 7) || '_' || (k % 3) || ' keeps failing'
    WHEN k % 4 = 1 THEN 'stuck on question ' || (k % 7) || '.' || (k % 3) ELSE 'my groupby is broken ' || k END AS question,
  CASE WHEN event_type <> 'click' THEN NULL WHEN k % 10 = 8 THEN '' ELSE 'reply ' || event_id END AS response,
  CASE WHEN k % 5 = 0 THEN 'chatgpt' WHEN k % 5 = 1 THEN '' ELSE 'tutor' END AS mode,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'q' || (k % 7) || '_' || (k % 3) END AS grader_id,
  CASE event_type WHEN 'error' THEN 'false' WHEN 'purchase' THEN 'true' END AS success,
  CASE WHEN event_type <> 'signup' THEN NULL WHEN k % 3 = 0 THEN 'Traceback (most recent call last)' ELSE 'ok' END AS notebook_json FROM ev)"""
HEADS = LOG + """,
heads AS (SELECT conv_id, min(event_id) AS chatlog_id, max(notebook) AS notebook, min(us) AS started_us FROM log WHERE event_type IN ('tutor_query', 'tutor_response') GROUP BY conv_id)"""
TURNS = HEADS + """,
flagged AS (SELECT *, event_type = 'tutor_query' AND coalesce(question, '') <> '' AS asked FROM log WHERE event_type IN ('tutor_query', 'tutor_response')),
opened AS (SELECT *, count(CASE WHEN asked THEN 1 END) OVER (PARTITION BY conv_id ORDER BY event_id) AS asks FROM flagged),
turns AS (SELECT o.conv_id, h.chatlog_id, row_number() OVER (PARTITION BY o.conv_id ORDER BY event_id) - 1 AS turn_index, CASE WHEN asked THEN 'student' ELSE 'tutor' END AS role,
  CASE WHEN asked THEN question ELSE response END AS text, CASE WHEN asked THEN asks - 1 END AS student_index, us, CASE WHEN asked THEN mode ELSE '' END AS mode, event_id, user_key, o.notebook, k
  FROM opened o JOIN heads h USING (conv_id) WHERE asked OR (event_type = 'tutor_response' AND coalesce(response, '') <> '' AND asks > 0))"""
BRACKETS = """,
convs AS (SELECT conv_id, user_key, notebook, min(us) AS t0, max(us) AS t1, count(*) AS n_messages FROM log WHERE event_type = 'tutor_query' GROUP BY ALL),
runs AS (SELECT user_key, notebook, us AS run_us, event_id AS run_id, grader_id, success FROM log WHERE event_type = 'autograder_info')"""
_B, _A = BEFORE * 60_000_000, AFTER * 60_000_000
SEQUENCES = LOG + BRACKETS + f""",
seqs AS (SELECT c.*, (SELECT r.success FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t0 - {_B} AND c.t0 ORDER BY r.run_us DESC, r.run_id DESC LIMIT 1) AS last_before,
  EXISTS (SELECT 1 FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t1 AND c.t1 + {_A} AND r.success = 'true') AS passed,
  EXISTS (SELECT 1 FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t1 AND c.t1 + {_A}) AS any_after FROM convs c),
classed AS (SELECT conv_id, user_key, notebook, n_messages, CASE WHEN last_before IS NULL THEN 'ask-first' WHEN last_before = 'false' THEN 'fail-then-ask' ELSE 'pass-then-ask' END AS pre,
  CASE WHEN passed THEN 'quick-pass' WHEN any_after THEN 'fail-after' ELSE 'no-run-after' END AS outcome FROM seqs)"""


@query(SEQUENCES + " SELECT pre, outcome, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY pre) AS share FROM classed GROUP BY pre, outcome")
def sequence_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.outcome_table(sequences.sequences(D.log(spark, sf_dir), BEFORE, AFTER))


@query(SEQUENCES + " SELECT conv_id, n_messages, pre, outcome FROM classed")
def sequence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sequences(D.log(spark, sf_dir), BEFORE, AFTER).select("conv_id", "n_messages", "pre", "outcome")


RUNS = f"SELECT c.conv_id, r.run_us, r.run_id, r.grader_id, r.success = 'true' AS success FROM convs c JOIN runs r ON r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t0 - {_B} AND c.t1 + {_A} WHERE r.success IS NOT NULL"


@query(LOG + BRACKETS + f" {RUNS}")
def sequence_runs_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.bracket_runs(D.log(spark, sf_dir), BEFORE, AFTER)


@query(SEQUENCES.replace("classed AS", "unused AS") + "".join(f" {'UNION ALL' if i else ''} SELECT {b} AS before_minutes, {a} AS after_minutes, count(*) AS n, count(CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t0 - {b * 60_000_000} AND c.t0) THEN 1 END) AS with_run_before FROM convs c" for i, (b, a) in enumerate(WINDOWS)))
def window_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations have a run before them, for several windows: one join with the widest, then counts."""
    return sequences.runs_before(D.log(spark, sf_dir), WINDOWS)


_PLACED = ", ".join(f"({b}, {a})" for b, a in WINDOWS)


@query(LOG + BRACKETS + f""", w AS (SELECT * FROM (VALUES {_PLACED}) w(before_minutes, after_minutes)),
s AS (SELECT w.*, c.*, (SELECT arg_max({{'s': r.success}}, (r.run_us, r.run_id)) FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t0 - CAST(w.before_minutes AS BIGINT) * 60000000 AND c.t0) AS last,
  EXISTS (SELECT 1 FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.success = 'true' AND r.run_us BETWEEN c.t1 AND c.t1 + CAST(w.after_minutes AS BIGINT) * 60000000) AS passed,
  EXISTS (SELECT 1 FROM runs r WHERE r.user_key = c.user_key AND r.notebook = c.notebook AND r.run_us BETWEEN c.t1 AND c.t1 + CAST(w.after_minutes AS BIGINT) * 60000000) AS ran FROM convs c, w)
SELECT before_minutes, after_minutes, CASE WHEN last.s IS NULL THEN 'ask-first' WHEN last.s = 'false' THEN 'fail-then-ask' ELSE 'pass-then-ask' END AS pre,
  CASE WHEN passed THEN 'quick-pass' WHEN ran THEN 'fail-after' ELSE 'no-run-after' END AS outcome, count(*) AS n FROM s GROUP BY ALL""")
def window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and outcomes under several windows, from one join."""
    return sequences.window_sweep(D.log(spark, sf_dir), WINDOWS)


FLAGS = """,
flags AS (SELECT c.conv_id, coalesce(f.f, false) AS flag FROM (SELECT DISTINCT conv_id FROM heads) c LEFT JOIN (SELECT conv_id, bool_or(notebook_json LIKE '%Traceback%') AS f FROM log WHERE event_type = 'tutor_notebook_info' AND notebook_json IS NOT NULL GROUP BY conv_id) f USING (conv_id))"""


@query(HEADS + FLAGS + " SELECT conv_id, flag FROM flags")
def traceback_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.log(spark, sf_dir)
    return sequences.traceback_flags(log, E.heads(log))


@query(HEADS + " SELECT conv_id, chatlog_id, notebook, started_us FROM heads")
def conversation_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.heads(D.log(spark, sf_dir))


#: Ten days of the log, from 2024-01-05 on.
SINCE, UNTIL = 19727 * D.DAY, 19737 * D.DAY


@query(HEADS + f" SELECT conv_id, chatlog_id, notebook, started_us FROM heads WHERE started_us >= {SINCE} AND started_us < {UNTIL} ORDER BY chatlog_id LIMIT 50")
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_heads(E.heads(D.log(spark, sf_dir), SINCE, UNTIL), 50)


@query(HEADS + f" SELECT conv_id, chatlog_id, notebook, started_us FROM heads ORDER BY md5('{SEED}:' || chatlog_id), chatlog_id LIMIT 100")
def conversation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sampled_heads(E.heads(D.log(spark, sf_dir)), 100, SEED)


@query(LOG + " SELECT count(DISTINCT conv_id) AS n_conversations FROM log WHERE event_type IN ('tutor_query', 'tutor_response')")
def conversation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conversation_count(D.log(spark, sf_dir))


@query(TURNS + " SELECT greatest(0, (SELECT count(*) FROM heads) - (SELECT count(DISTINCT conv_id) FROM turns)) AS excluded")
def excluded_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.log(spark, sf_dir)
    fetched = E.assemble_turns(log).agg(F.countDistinct("conv_id").alias("fetched"))
    return E.conversation_count(log).crossJoin(fetched).select(F.greatest(F.lit(0), F.col("n_conversations") - F.col("fetched")).alias("excluded"))


@query(TURNS + " SELECT conv_id, chatlog_id, turn_index, role, text, student_index, us, mode FROM turns")
def turns_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.assemble_turns(D.log(spark, sf_dir)).select("conv_id", "chatlog_id", "turn_index", "role", "text", "student_index", "us", "mode")


@query(TURNS + """, c AS (SELECT *, string_agg(role || ': ' || text, chr(10)) OVER w AS ctx, count(*) OVER w AS n_context FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT c.conv_id, c.turn_index, n_context, coalesce(ctx, '(conversation start)') AS context_text,
  (SELECT t.text FROM turns t WHERE t.conv_id = c.conv_id AND t.turn_index > c.turn_index AND t.role = 'tutor' ORDER BY t.turn_index LIMIT 1) AS context_after FROM c WHERE role = 'student'""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns.with_context(E.assemble_turns(D.log(spark, sf_dir))).filter("role = 'student'")
    return t.select("conv_id", "turn_index", F.size("context").alias("n_context"), T.render_window(F.col("context")).alias("context_text"), "context_after")


LATENCY = """, tutors AS (SELECT s.conv_id, s.turn_index, s.us, (SELECT max(t.turn_index) FROM turns t WHERE t.conv_id = s.conv_id AND t.role = 'tutor' AND t.turn_index < s.turn_index) AS prior FROM turns s WHERE s.role = 'student'),
waits AS (SELECT x.conv_id, x.turn_index, (x.us - t.us) / 1e6 AS latency_seconds, x.prior IS NULL AS opening FROM tutors x LEFT JOIN turns t ON t.conv_id = x.conv_id AND t.turn_index = x.prior),
bucketed AS (SELECT *, CASE WHEN opening THEN 'conversation-opening' WHEN latency_seconds IS NULL THEN 'unknown' WHEN latency_seconds < 120 THEN 'rapid' WHEN latency_seconds < 1800 THEN 'working' WHEN latency_seconds < 21600 THEN 'delayed' ELSE 'returned' END AS latency_bucket FROM waits)"""


@query(TURNS + LATENCY + " SELECT conv_id, turn_index, latency_seconds, latency_bucket FROM bucketed")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns.with_latency(E.assemble_turns(D.log(spark, sf_dir))).filter("role = 'student'")
    return t.select("conv_id", "turn_index", "latency_seconds", "latency_bucket")


@query(TURNS + LATENCY + """ SELECT conv_id, turn_index, CASE WHEN opening THEN '(conversation opening)' WHEN latency_seconds IS NULL THEN '(unknown)' ELSE
  CASE WHEN latency_seconds < 120 THEN CAST(round_even(latency_seconds, 0) AS BIGINT) || ' seconds' WHEN latency_seconds < 7200 THEN CAST(round_even(latency_seconds / 60, 0) AS BIGINT) || ' minutes'
    WHEN latency_seconds < 172800 THEN CAST(round_even(latency_seconds / 3600, 0) AS BIGINT) || ' hours' ELSE CAST(round_even(latency_seconds / 86400, 0) AS BIGINT) || ' days' END || ' (' || latency_bucket || ')' END AS rendered FROM bucketed""")
def latency_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns.with_latency(E.assemble_turns(D.log(spark, sf_dir))).filter("role = 'student'")
    return t.select("conv_id", "turn_index", T.render_latency(F.col("latency_seconds"), F.col("latency_bucket")).alias("rendered"))


DEFECT = """, modes AS (SELECT *, last_value(nullif(mode, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mode_before FROM turns WHERE role = 'student')"""


@query(TURNS + DEFECT + " SELECT conv_id, turn_index, mode, coalesce(mode = 'chatgpt' AND mode_before = 'tutor', false) AS defected FROM modes")
def defections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns.with_defection(E.assemble_turns(D.log(spark, sf_dir))).filter("role = 'student'")
    return t.select("conv_id", "turn_index", "mode", "defected")


TERCILES = """, sizes AS (SELECT conv_id, count(CASE WHEN role = 'student' THEN 1 END) AS n_student FROM turns GROUP BY conv_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_student, conv_id) - 1 AS rank, count(*) OVER () AS total FROM sizes),
terciles AS (SELECT conv_id, n_student, ['short', 'mid', 'long'][least(rank // greatest(1, total // 3), 2) + 1] AS tercile FROM ranked)"""


@query(TURNS + TERCILES + " SELECT conv_id, n_student, tercile FROM terciles")
def length_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.length_terciles(E.assemble_turns(D.log(spark, sf_dir)))


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'),
n AS (SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS n_student FROM t GROUP BY conv_id),
s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS student_index FROM t WHERE role = 'user')
SELECT s.conv_id, s.turn, CASE WHEN student_index < n_student / 2.0 THEN 'early' ELSE 'late' END AS position FROM s JOIN n USING (conv_id)""")
def conversation_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early and late student turns of the chat table, read as a log whose user turns are queries."""
    c = D.read(spark, sf_dir, "conversations").filter("role <> 'system'")
    asked = F.col("role") == "user"
    log = c.select(
        "conv_id", F.col("turn").alias("event_id"), F.lit(None).cast("bigint").alias("us"), F.when(asked, "tutor_query").otherwise("tutor_response").alias("event_type"),
        F.when(asked, F.concat("text", F.lit(" "))).alias("question"), F.when(~asked, F.concat("text", F.lit(" "))).alias("response"), F.lit("").alias("mode"), F.lit("").alias("user_key"), F.lit("").alias("notebook"),
    )
    t = E.assemble_turns(log)
    return turns.with_position(t, turns.length_terciles(t)).filter("role = 'student'").select("conv_id", F.col("event_id").alias("turn"), "position")


_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _ref(c: str) -> str:
    found = [rf"nullif(regexp_extract({c}, '{p}', 2), '')" for p in (rf"{_L}[qQ]([0-9]+([._][0-9]+)*){_R}", rf"{_L}[qQ][uU][eE][sS][tT][iI][oO][nN]\s+([0-9]+(\.[0-9]+)*){_R}", rf"{_L}([0-9]+\.[0-9]+(\.[0-9]+)*){_R}")]
    return f"coalesce('q' || replace(coalesce({', '.join(found)}), '.', '_'), '')"


@query(f"SELECT doc_id, {_ref('text')} AS question_ref FROM documents")
def question_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), T.question_ref(F.col("text"))).otherwise("").alias("question_ref"))


FACTS = TURNS + BRACKETS + FLAGS + f""",
bracketed AS ({RUNS}),
asked AS (SELECT *, {_ref('text')} AS question_ref FROM turns WHERE role = 'student'),
met AS (SELECT a.*, b.run_us, b.run_id, b.grader_id, b.success, a.question_ref <> '' AND coalesce(b.grader_id = a.question_ref OR starts_with(b.grader_id, a.question_ref || '_'), false) AS hit FROM asked a LEFT JOIN bracketed b USING (conv_id)),
pooled AS (SELECT *, bool_or(hit) OVER (PARTITION BY event_id) AS scoped FROM met),
latest AS (SELECT event_id, arg_max({{'us': run_us, 'grader': grader_id, 'ok': success}}, (run_us, run_id)) AS last FROM pooled WHERE run_us <= us AND (hit OR NOT scoped) GROUP BY event_id),
facts AS (SELECT a.chatlog_id, a.turn_index AS message_index, a.conv_id, a.text, a.us, a.mode, a.k, a.question_ref, CASE WHEN (SELECT bool_or(hit) FROM met m WHERE m.event_id = a.event_id) THEN 'question' ELSE 'notebook' END AS seq_granularity,
  CASE WHEN l.last IS NULL THEN 'ask-first' WHEN l.last.ok THEN 'pass-then-ask' ELSE 'fail-then-ask' END AS pre_pattern, (a.us - l.last.us) / 6e7 AS last_run_minutes, coalesce(l.last.grader, '') AS last_run_grader, l.last.ok AS last_run_success, f.flag AS snapshot_traceback
  FROM asked a LEFT JOIN latest l USING (event_id) JOIN flags f ON f.conv_id = a.conv_id)"""


def _facts(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    log = D.log(spark, sf_dir)
    t = E.assemble_turns(log)
    if placed:
        t = turns.with_defection(turns.with_position(t, turns.length_terciles(t)))
    f = sequences.message_facts(t, sequences.bracket_runs(log, BEFORE, AFTER), sequences.traceback_flags(log, E.heads(log)), T.question_ref(F.col("text")))
    return f.withColumnRenamed("turn_index", "message_index")


@query(FACTS + " SELECT chatlog_id, message_index, question_ref, seq_granularity, pre_pattern, last_run_minutes, last_run_grader, last_run_success, snapshot_traceback, pre_pattern <> 'ask-first' AS attempted, snapshot_traceback OR coalesce(NOT last_run_success, false) AS error_verified FROM facts")
def message_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chatlog_id", "message_index", "question_ref", "seq_granularity", "pre_pattern", "last_run_minutes", "last_run_grader", "last_run_success", "snapshot_traceback", "attempted", "error_verified")


@query(FACTS + """ SELECT chatlog_id, message_index, CASE WHEN pre_pattern = 'ask-first' THEN 'No autograder activity in the 1440 min before this message (' || seq_granularity || '-level)'
  ELSE 'last run ' || CAST(round_even(last_run_minutes, 0) AS BIGINT) || 'm before this message: ' || CASE WHEN last_run_success THEN 'PASSED' ELSE 'FAILED' END || ' (' || last_run_grader || ', ' || seq_granularity || '-level)' END
  || CASE WHEN snapshot_traceback THEN '; notebook snapshot at conversation start showed a traceback' ELSE '' END AS rendered,
  CASE mode WHEN 'chatgpt' THEN 'plain-ChatGPT mode — the student toggled the tutor persona off for this message' WHEN 'tutor' THEN 'tutor mode' ELSE 'unknown (older log)' END AS rendered_mode FROM facts""")
def sequence_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    said = T.render_sequence(c("pre_pattern"), c("seq_granularity"), c("last_run_minutes"), c("last_run_success"), c("last_run_grader"), c("snapshot_traceback"), BEFORE)
    return _facts(spark, sf_dir).select("chatlog_id", "message_index", said.alias("rendered"), T.render_mode(c("mode")).alias("rendered_mode"))


STRATA = FACTS + DEFECT + TERCILES + """,
strata AS (SELECT f.chatlog_id, f.message_index, t.tercile || '/' || CASE WHEN m.student_index < t.n_student / 2.0 THEN 'early' ELSE 'late' END || CASE WHEN pre_pattern = 'fail-then-ask' THEN '/seq-fail' WHEN pre_pattern = 'ask-first' THEN '/seq-askfirst' WHEN m.mode = 'chatgpt' AND m.mode_before = 'tutor' THEN '/seq-defect' ELSE '' END AS stratum
  FROM facts f JOIN modes m ON m.conv_id = f.conv_id AND m.turn_index = f.message_index JOIN terciles t ON t.conv_id = f.conv_id)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _facts(spark, sf_dir, placed=True).select(*sampling.KEY, sequences.stratum(c("tercile"), c("position"), c("pre_pattern"), c("defected")).alias("stratum"))


WORDS = "MAP {'short': 'short conversation', 'mid': 'medium conversation', 'long': 'long conversation', 'early': 'early turn', 'late': 'late turn'}"


@query(STRATA + f" SELECT stratum, count(*) AS n, coalesce({WORDS}[split_part(stratum, '/', 1)], split_part(stratum, '/', 1)) || ' · ' || coalesce({WORDS}[regexp_replace(stratum, '^[^/]*/?', '')], regexp_replace(stratum, '^[^/]*/?', '')) AS plain FROM strata GROUP BY stratum")
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n")).withColumn("plain", T.plain_stratum(F.col("stratum")))


@query(STRATA + f" SELECT chatlog_id, message_index, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || chatlog_id || ':' || message_index), chatlog_id, message_index) AS rn FROM strata) ORDER BY rn, stratum LIMIT 60")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(_strata(spark, sf_dir), 60, SEED)


VERDICTS = TURNS + """,
labels_ AS (SELECT * FROM (VALUES (0, 'confused', 2), (1, 'debugging', 3), (2, 'frustrated', 4), (3, 'planning', 8)) l(label_ord, label, divisor)),
verdicts AS (SELECT chatlog_id, turn_index AS message_index, conv_id, mode, us, k, text, label, label_ord, k % divisor = 0 AS applies, CASE WHEN k % divisor = 0 THEN label || ' because the student wrote ' || text ELSE '' END AS rationale,
  k % 2 <> 0 AND k % 3 <> 0 AND k % 5 = 0 AS no_label_fits FROM turns, labels_ WHERE role = 'student'),
msgs AS (SELECT chatlog_id, message_index, sum(CAST(applies AS INTEGER)) AS n_labels, bool_or(no_label_fits) AS abstained FROM verdicts GROUP BY ALL)"""


@query(VERDICTS + " SELECT count(*) AS messages, count(DISTINCT chatlog_id) AS conversations, count(CASE WHEN n_labels > 0 THEN 1 END) AS with_label, CAST(round_even(sum(n_labels) / count(CASE WHEN n_labels > 0 THEN 1 END), 1) AS DOUBLE) AS labels_per_labeled FROM msgs")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.totals(D.verdicts(spark, sf_dir))


@query(VERDICTS + " SELECT l.label_ord, l.label, count(CASE WHEN v.applies THEN 1 END) AS n, count(CASE WHEN v.applies THEN 1 END) / (SELECT count(*) FROM msgs) AS share FROM labels_ l LEFT JOIN verdicts v USING (label) GROUP BY ALL")
def label_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.prevalence(D.verdicts(spark, sf_dir), D.labels(spark))


WEEKLY = VERDICTS + """,
weeks AS (SELECT chatlog_id, ((started_us - (SELECT min(started_us) FROM heads)) // 86400000000) // 7 AS week FROM heads),
weekly AS (SELECT week, label, label_ord, sum(CAST(applies AS INTEGER)) / count(*) AS share FROM verdicts JOIN weeks USING (chatlog_id) GROUP BY ALL)"""


@query(HEADS + " SELECT chatlog_id, ((started_us - (SELECT min(started_us) FROM heads)) // 86400000000) // 7 AS week FROM heads")
def conversation_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.conversation_weeks(E.heads(D.log(spark, sf_dir))).select("chatlog_id", "week")


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.weekly(D.verdicts(spark, sf_dir), turns.conversation_weeks(E.heads(D.log(spark, sf_dir))))


@query(WEEKLY + " SELECT week, label, label_ord, share FROM weekly")
def weekly_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly(spark, sf_dir)


@query(WEEKLY + ", j AS (SELECT *, share - lag(share) OVER w AS delta, week - lag(week) OVER w AS gap FROM weekly WINDOW w AS (PARTITION BY label ORDER BY week)) SELECT label, week, CAST(round_even(delta, 4) AS DOUBLE) AS delta FROM j WHERE gap = 1 ORDER BY abs(delta) DESC, label_ord, week LIMIT 1")
def largest_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.largest_jump(_weekly(spark, sf_dir))


PAIRS = VERDICTS + ", pairs AS (SELECT x.label AS a, y.label AS b, x.rationale AS ra, y.rationale AS rb FROM verdicts x JOIN verdicts y ON x.chatlog_id = y.chatlog_id AND x.message_index = y.message_index AND x.label < y.label WHERE x.applies AND y.applies)"


@query(PAIRS + " SELECT a, b, count(*) AS n_both, count(*) / (SELECT count(*) FROM msgs) AS share FROM pairs GROUP BY a, b ORDER BY n_both DESC, a, b LIMIT 3")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_pairs(D.verdicts(spark, sf_dir))


@query(PAIRS + """, w AS (SELECT *, list_distinct(list_filter(string_split(lower(ra), ' '), lambda s: s <> '')) AS wa, list_distinct(list_filter(string_split(lower(rb), ' '), lambda s: s <> '')) AS wb FROM pairs),
g AS (SELECT a, b, count(*) AS n_both, avg(len(list_intersect(wa, wb)) / greatest(1, len(list_distinct(list_concat(wa, wb))))) AS rationale_overlap FROM w GROUP BY a, b),
e AS (SELECT label, count(*) AS n FROM verdicts WHERE applies GROUP BY label)
SELECT a, b, n_both / (x.n + y.n - n_both) AS jaccard, n_both, rationale_overlap FROM g JOIN e x ON x.label = a JOIN e y ON y.label = b WHERE n_both / (x.n + y.n - n_both) >= 0.4""")
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.label_overlap(D.verdicts(spark, sf_dir), Params.overlap_jaccard)


@query(VERDICTS + ", c AS (SELECT h.chatlog_id, least(count(CASE WHEN n_labels > 0 THEN 1 END), 15) AS bin FROM heads h LEFT JOIN msgs USING (chatlog_id) GROUP BY h.chatlog_id) SELECT r.range AS bin, count(c.bin) AS n FROM range(16) r LEFT JOIN c ON c.bin = r.range GROUP BY r.range")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.coverage_histogram(D.verdicts(spark, sf_dir), E.heads(D.log(spark, sf_dir)))


@query(VERDICTS + f", z AS (SELECT chatlog_id FROM heads WHERE chatlog_id NOT IN (SELECT chatlog_id FROM verdicts WHERE applies) ORDER BY md5('{SEED}:' || chatlog_id), chatlog_id LIMIT 5) SELECT z.chatlog_id, t.text FROM z JOIN turns t ON t.chatlog_id = z.chatlog_id AND t.student_index = 0")
def zero_label_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.log(spark, sf_dir)
    firsts = E.assemble_turns(log).filter("student_index = 0")
    return summary.zero_examples(D.verdicts(spark, sf_dir), E.heads(log), firsts, 5, SEED)


@query(VERDICTS + " SELECT CAST(sum(CAST(abstained AS INTEGER)) AS BIGINT) AS abstained, count(*) AS messages, sum(CAST(abstained AS INTEGER)) / count(*) AS rate FROM msgs")
def abstention_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.abstention(D.verdicts(spark, sf_dir))


@query(VERDICTS + " SELECT label, count(CASE WHEN mode = 'tutor' THEN 1 END) AS tutor, count(CASE WHEN mode = 'chatgpt' THEN 1 END) AS chatgpt, count(CASE WHEN mode = '' THEN 1 END) AS unknown, count(CASE WHEN mode NOT IN ('tutor', 'chatgpt', '') THEN 1 END) AS other FROM verdicts WHERE applies GROUP BY label")
def mode_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.mode_split(D.verdicts(spark, sf_dir))


def _flip(seed: str, one_in: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || chatlog_id || ':' || message_index || ':' || label), 1, 6) AS BIGINT) % {one_in} = 0"


def _audit_sql(i: int) -> str:
    return f"SELECT {i} AS annotator, chatlog_id, message_index, label, applies <> ({_flip(f'human{i}', 6 + i)}) AS applies FROM verdicts WHERE NOT ({_flip(f'judged{i}', 3)})"


AUDIT = VERDICTS + f", audit AS ({_audit_sql(0)})"
CONFUSION = AUDIT + """,
tally AS (SELECT label, count(CASE WHEN a.applies AND v.applies THEN 1 END) AS tp, count(CASE WHEN NOT a.applies AND v.applies THEN 1 END) AS fp, count(CASE WHEN a.applies AND NOT v.applies THEN 1 END) AS fn, count(CASE WHEN NOT a.applies AND NOT v.applies THEN 1 END) AS tn
  FROM audit a JOIN verdicts v USING (chatlog_id, message_index, label) GROUP BY label),
rates AS (SELECT *, tp + fp + fn + tn AS n, tp + fn AS support, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS agreement FROM tally),
confusion AS (SELECT label, tp, fp, fn, tn, support, precision, recall, specificity, agreement,
  CASE WHEN n > 0 AND (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) <> n * n THEN (agreement - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) END AS kappa,
  CASE WHEN recall + specificity - 1 > 0 THEN least(1.0, greatest(0.0, ((tp + fp) / n + specificity - 1) / (recall + specificity - 1))) END AS corrected_prevalence FROM rates)"""


@query(CONFUSION + " SELECT * FROM confusion")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confusion(D.audit(spark, sf_dir, 0), D.verdicts(spark, sf_dir))


@query(CONFUSION + f", second AS ({_audit_sql(1)}), ceilings AS (SELECT label, count(CASE WHEN a.applies = s.applies THEN 1 END) / count(*) AS ceiling FROM audit a JOIN second s USING (chatlog_id, message_index, label) GROUP BY label) SELECT c.*, ceiling, coalesce(kappa < 0.2, false) AS near_chance FROM confusion c LEFT JOIN ceilings USING (label)")
def validation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = D.audit(spark, sf_dir, 0), D.audit(spark, sf_dir, 1)
    return quality.validation_table(a, D.verdicts(spark, sf_dir), quality.human_ceilings(a, b))


@query(CONFUSION.replace("WITH ev AS", "WITH ev AS", 1) + f", second AS ({_audit_sql(1)}), ceilings AS (SELECT label, count(CASE WHEN a.applies = s.applies THEN 1 END) / count(*) AS ceiling FROM audit a JOIN second s USING (chatlog_id, message_index, label) GROUP BY label) SELECT label, support FROM confusion JOIN ceilings USING (label) WHERE support >= 25 AND precision >= 0.8 * ceiling AND kappa >= 0.4")
def admitted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = D.audit(spark, sf_dir, 0), D.audit(spark, sf_dir, 1)
    return quality.admitted(quality.validation_table(a, D.verdicts(spark, sf_dir), quality.human_ceilings(a, b))).select("label", "support")


@query("""WITH a AS (SELECT doc_id, toxic = 1 AS human, n_chars >= 1000 AS model FROM labels JOIN documents USING (doc_id))
SELECT 'toxic' AS label, count(CASE WHEN human AND model THEN 1 END) AS tp, count(CASE WHEN NOT human AND model THEN 1 END) AS fp, count(CASE WHEN human AND NOT model THEN 1 END) AS fn, count(CASE WHEN NOT human AND NOT model THEN 1 END) AS tn FROM a""")
def document_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table as a human audit of a mechanical verdict on documents."""
    key = lambda df: df.withColumnsRenamed({"doc_id": "chatlog_id"}).withColumn("message_index", F.lit(0)).withColumn("label", F.lit("toxic"))
    human = key(D.read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("applies")))
    model = key(D.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 1000).alias("applies")))
    return quality.confusion(human, model).select("label", "tp", "fp", "fn", "tn")


ANCHORS = "(VALUES ('confused', 'fail-then-ask'), ('debugging', 'fail-then-ask'), ('planning', 'ask-first')) n(label, expected_pattern)"


@query(FACTS + ", " + VERDICTS.split("turns AS ", 1)[1].split("AND asks > 0)),", 1)[-1].split("AND asks > 0)),")[-1].lstrip(",\n") + f""",
m AS (SELECT v.*, f.pre_pattern FROM verdicts v LEFT JOIN facts f USING (chatlog_id, message_index)),
base AS (SELECT expected_pattern, (SELECT count(*) FROM facts f WHERE f.pre_pattern = e.expected_pattern) / (SELECT count(*) FROM msgs) AS baseline FROM (SELECT DISTINCT expected_pattern FROM {ANCHORS}) e),
c AS (SELECT n.label, n.expected_pattern, count(CASE WHEN m.applies AND m.pre_pattern = n.expected_pattern THEN 1 END) AS in_pattern, count(CASE WHEN m.applies THEN 1 END) AS total_positives FROM {ANCHORS} LEFT JOIN m USING (label) GROUP BY ALL)
SELECT label, expected_pattern, in_pattern, total_positives, baseline, coalesce(in_pattern / nullif(total_positives, 0), 0) AS concentration, total_positives > 0 AND coalesce(in_pattern / nullif(total_positives, 0), 0) < baseline AS flagged FROM c JOIN base USING (expected_pattern)""")
def outcome_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = spark.createDataFrame([("confused", "fail-then-ask"), ("debugging", "fail-then-ask"), ("planning", "ask-first")], "label string, expected_pattern string")
    return quality.outcome_anchors(D.verdicts(spark, sf_dir), _facts(spark, sf_dir), anchors)


ENTROPY = VERDICTS + ", votes AS (" + " UNION ALL ".join(f"SELECT {r} AS run, chatlog_id, message_index, label, applies <> ({_flip(f'vote{r}', 5 + r)}) AS applies FROM verdicts" for r in range(5)) + """),
p AS (SELECT chatlog_id, message_index, label, avg(CAST(applies AS DOUBLE)) AS p FROM votes GROUP BY ALL),
entropies AS (SELECT chatlog_id, message_index, avg(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END) AS mean_entropy, max(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END) AS max_entropy FROM p GROUP BY ALL)"""


@query(ENTROPY + " SELECT chatlog_id, message_index, round(mean_entropy, 9) AS mean_entropy, round(max_entropy, 9) AS max_entropy FROM entropies")
def vote_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.vote_entropy(D.votes(spark, sf_dir)).select(*sampling.KEY, F.round("mean_entropy", 9).alias("mean_entropy"), F.round("max_entropy", 9).alias("max_entropy"))


@query(ENTROPY + " SELECT chatlog_id, message_index, round(max_entropy, 9) AS max_entropy FROM entropies ORDER BY round(max_entropy, 9) DESC, chatlog_id, message_index LIMIT 20")
def routed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = quality.vote_entropy(D.votes(spark, sf_dir)).withColumn("max_entropy", F.round("max_entropy", 9))
    return sampling.most_uncertain(e, 20).select(*sampling.KEY, "max_entropy")


@query(VERDICTS + ", audits AS (" + " UNION ALL ".join(_audit_sql(i) for i in range(3)) + """),
common AS (SELECT chatlog_id, message_index, label FROM audits GROUP BY ALL HAVING count(DISTINCT annotator) = 3),
h AS (SELECT a.* FROM audits a JOIN common USING (chatlog_id, message_index, label)),
i AS (SELECT x.annotator, x.chatlog_id, x.message_index, count(CASE WHEN v.applies = y.applies THEN 1 END) AS model, count(CASE WHEN x.applies = y.applies THEN 1 END) AS human
  FROM h x JOIN h y USING (chatlog_id, message_index, label) JOIN verdicts v USING (chatlog_id, message_index, label) WHERE x.annotator <> y.annotator GROUP BY ALL)
SELECT annotator, count(*) AS n_items, count(CASE WHEN model >= human THEN 1 END) / count(*) AS advantage, count(CASE WHEN model >= human THEN 1 END) / count(*) >= 0.4 AS wins FROM i GROUP BY annotator""")
def alt_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alt_test(D.audits(spark, sf_dir, 0, 1, 2), D.verdicts(spark, sf_dir), Params.alt_test_epsilon)


@query(VERDICTS + f", a AS (SELECT chatlog_id, message_index, label, applies <> ({_flip('ablated', 8)}) AS after FROM verdicts) SELECT label, count(CASE WHEN after <> applies THEN 1 END) AS flips, count(*) AS total FROM verdicts JOIN a USING (chatlog_id, message_index, label) GROUP BY label")
def ablation_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages labeled again, with a verdict in eight turned, as the ablation's input."""
    v = D.verdicts(spark, sf_dir)
    again = v.withColumn("applies", F.col("applies") != D.flips("ablated", 8))
    return quality.flip_stats(v, again)


_H = f"md5('{SEED}:' || chatlog_id || ':' || message_index)"


@query(ENTROPY + f""",
pool AS (SELECT DISTINCT chatlog_id, message_index, no_label_fits AS abstained FROM verdicts WHERE mode <> ''),
s1 AS (SELECT chatlog_id, message_index FROM pool WHERE abstained ORDER BY {_H}, chatlog_id, message_index LIMIT 16),
r2 AS (SELECT chatlog_id, message_index, row_number() OVER (ORDER BY round(max_entropy, 9) DESC, chatlog_id, message_index) + (SELECT count(*) FROM s1) AS rn FROM pool JOIN entropies USING (chatlog_id, message_index) ANTI JOIN s1 USING (chatlog_id, message_index) WHERE round(max_entropy, 9) > 0),
s2 AS (SELECT chatlog_id, message_index FROM r2 WHERE rn - 1 < 32),
r3 AS (SELECT chatlog_id, message_index, row_number() OVER (ORDER BY {_H}, chatlog_id, message_index) + (SELECT count(*) FROM s1) + (SELECT count(*) FROM s2) AS rn FROM pool ANTI JOIN s1 USING (chatlog_id, message_index) ANTI JOIN s2 USING (chatlog_id, message_index))
SELECT *, 'abstained' AS audit_stratum FROM s1 UNION ALL SELECT *, 'high-entropy' FROM s2 UNION ALL SELECT chatlog_id, message_index, 'random' FROM r3 WHERE rn <= 40""")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the older log, without a mode, count as seen by the instructor and are left out."""
    pool = D.messages(spark, sf_dir).filter("mode <> ''").select(*sampling.KEY, D.abstains().alias("no_label_fits"))
    e = quality.vote_entropy(D.votes(spark, sf_dir)).withColumn("max_entropy", F.round("max_entropy", 9))
    return sampling.audit_sample(pool, e, 40, SEED)


@query(VERDICTS + f""",
r AS (SELECT *, CASE WHEN applies THEN 0 WHEN no_label_fits THEN 1 ELSE 2 END AS rank, md5('{SEED}:' || label || ':' || chatlog_id || ':' || message_index) AS h FROM verdicts),
n AS (SELECT *, row_number() OVER (PARTITION BY label, rank ORDER BY h, chatlog_id, message_index) AS rn FROM r),
q AS (SELECT * FROM n WHERE rank > 0 OR rn <= 15), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank, rn) AS every FROM q)
SELECT label, chatlog_id, message_index, ['model-positive', 'abstained-negative', 'random-negative'][rank + 1] AS audit_stratum FROM o WHERE rank = 0 OR every <= 30""")
def label_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.label_audit_samples(D.verdicts(spark, sf_dir), 30, SEED).drop("place")


@query(VERDICTS + f" SELECT chatlog_id, message_index, text FROM verdicts WHERE label = 'planning' AND applies ORDER BY {_H}, chatlog_id, message_index LIMIT 5")
def label_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives = D.verdicts(spark, sf_dir).filter("label = 'planning' AND applies").select(*sampling.KEY)
    return sampling.example_sample(positives, D.messages(spark, sf_dir).select(*sampling.KEY, "text"), 5, SEED)


@query(VERDICTS + " SELECT chatlog_id, message_index, string_agg(label, ',' ORDER BY label) FILTER (WHERE applies) AS applied FROM verdicts GROUP BY ALL ORDER BY max(us) DESC, chatlog_id, message_index LIMIT 3")
def recent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.verdicts(spark, sf_dir).groupBy(*sampling.KEY).agg(F.max("us").alias("us"), F.array_sort(F.collect_list(F.when(F.col("applies"), F.col("label")))).alias("on"))
    return sampling.recent(v).select(*sampling.KEY, F.nullif(F.array_join("on", ","), F.lit("")).alias("applied"))


_GRAMS = "list_distinct(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' ')))"


@query(f"""WITH a AS (SELECT 'benchmark.' || item_id AS where_, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark), s AS (SELECT regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
g AS (SELECT DISTINCT unnest({_GRAMS}) AS g FROM s WHERE len(w) >= 8) SELECT DISTINCT where_ AS "where" FROM (SELECT where_, unnest({_GRAMS}) AS g FROM a WHERE len(w) >= 8) x JOIN g USING (g)""")
def lint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = D.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark."), "item_id").alias("where"), "text")
    return profile.lint_overlap(artifacts, D.read(spark, sf_dir, "documents").select("text"), Params.lint_words)


@query(r"SELECT name, field, words, cap FROM (SELECT 'item' || item_id AS name, CASE WHEN item_id % 2 = 0 THEN 'description' ELSE 'positive_criteria' END AS field, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words, CASE WHEN item_id % 2 = 0 THEN 20 ELSE 25 END AS cap FROM benchmark) WHERE words > cap")
def brevity_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.read(spark, sf_dir, "benchmark")
    field = F.when(F.col("item_id") % 2 == 0, "description").otherwise("positive_criteria")
    fields = b.select(F.concat(F.lit("item"), "item_id").alias("name"), field.alias("field"), "text")
    return profile.brevity(fields, F.when(F.col("field") == "description", 20).otherwise(25))


@query("WITH l AS (SELECT 0 AS layer, n_nationkey AS ord, n_name AS name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 1, n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, r_regionkey, r_name || ' region' FROM region) SELECT layer, ord, name FROM l")
def schema_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of names, as instructor labels, promoted concepts and affect labels."""
    nation, region = D.read(spark, sf_dir, "nation"), D.read(spark, sf_dir, "region")
    layer = lambda i: nation.filter(F.col("n_regionkey") == i).select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    return profile.compose(layer(0), layer(1), region.select(F.col("r_regionkey").alias("ord"), F.concat("r_name", F.lit(" region")).alias("name")))


@query("WITH l AS (SELECT 0 AS rank, 'affect' AS category, n_name AS name FROM nation UNION ALL SELECT 1, 'intent', n_name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 2, 'concept', n_name FROM nation WHERE n_regionkey = 1) SELECT name, arg_max(category, rank) AS category FROM l GROUP BY name")
def label_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.read(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    return profile.categories(("affect", n), ("intent", n.filter("n_regionkey < 3")), ("concept", n.filter("n_regionkey = 1")))


@query(VERDICTS + " SELECT DISTINCT chatlog_id, message_index FROM verdicts WHERE mode <> 'tutor'")
def unlabeled_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in tutor mode were labeled under this schema, those in chatgpt mode under an older one, which does not count."""
    m = D.messages(spark, sf_dir)
    done = m.filter("mode <> ''").select(*sampling.KEY, F.when(F.col("mode") == "tutor", "new").otherwise("old").alias("schema_version"))
    return profile.todo(m, done, "new").select(*sampling.KEY)


@query(VERDICTS + f" SELECT chatlog_id, message_index, text FROM verdicts WHERE label_ord = 0 ORDER BY {_H}, chatlog_id, message_index LIMIT 30")
def blind_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an annotator sees of a sample: texts, no verdict and no stratum."""
    m = D.messages(spark, sf_dir)
    sample = m.orderBy(sampling.drawn(SEED, *sampling.KEY), *sampling.KEY).limit(30)
    return audit.payload(sample, sample)


@query(TURNS + """, s AS (SELECT conv_id, count(*) AS n, max(notebook) AS notebook, string_agg('  student: ' || substr(text, 1, 160), chr(10) ORDER BY student_index) FILTER (WHERE student_index < 4) AS lines FROM turns WHERE role = 'student' GROUP BY conv_id)
SELECT conv_id, '[' || coalesce(nullif(notebook, ''), 'unknown') || ' · ' || n || ' student turns]' || chr(10) || lines AS digest FROM s""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.digest(E.assemble_turns(D.log(spark, sf_dir)))


@query("SELECT item_id, substr(sha256(text), 1, 12) AS version FROM benchmark")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "benchmark").select("item_id", profile.content_hash(F.col("text")).alias("version"))


@query(TURNS + ", m AS (SELECT mode AS state, lead(mode) OVER (PARTITION BY conv_id ORDER BY turn_index) AS next_state FROM turns WHERE role = 'student') SELECT state, next_state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY state) AS share FROM m WHERE next_state IS NOT NULL GROUP BY state, next_state")
def mode_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How modes follow each other within conversations: an extension."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn_index")
    m = E.assemble_turns(D.log(spark, sf_dir)).filter("role = 'student'").select(F.col("mode").alias("state"), F.lead("mode").over(w).alias("next_state")).filter("next_state IS NOT NULL")
    n = m.groupBy("state", "next_state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))
