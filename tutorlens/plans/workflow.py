"""Queries over the labeling workflow: providers, resumed runs, votes, prompts, snapshots, audit files. They join the catalogue."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.functions import prompts
from tutorlens.operators import clusters, labeling, quality, sampling, sketches, summary, trajectories, turns, verdicts
from tutorlens.params import Params
from tutorlens.plans import audit
from tutorlens.plans.session import Concept, Label, Profile, Session, accept_profile
from tutorlens.plans.catalogue import AFTER, AUDIT, BEFORE, DEFECT, ENTROPY, FACTS, HEADS, LATENCY, LOG, SEED, TERCILES, TURNS, VERDICTS, WORDS, _facts, _flip, query
from tutorlens.sources import events as E
from tutorlens.sources import snapshot
from tutorlens.sources import testdata as D
from tutorlens.sources.shared import fresh_folder, settled
from tutorlens.streaming import sessions

#: Labels of the offline provider with the words that it looks for.
CUES = (("failing", "keeps failing"), ("lost", "stuck,broken"), ("numbers", "question"))


def _cued(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CUES), "label string, cues string")


def _student(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.messages(spark, sf_dir).select("chatlog_id", F.col("message_index").cast("int").alias("message_index"), "text", "k")


CUED = TURNS + """,
cued AS (SELECT chatlog_id, turn_index AS message_index, k, c.label, CASE WHEN contains(lower(text), c.one) THEN c.one WHEN contains(lower(text), c.two) THEN c.two ELSE '' END AS evidence
  FROM turns, (VALUES ('failing', 'keeps failing', 'keeps failing'), ('lost', 'stuck', 'broken'), ('numbers', 'question', 'question')) c(label, one, two) WHERE role = 'student')"""
SAID = "SELECT chatlog_id, message_index, label, evidence <> '' AS applies, CASE WHEN evidence <> '' THEN 'mentions ' || evidence ELSE '(no rationale returned)' END AS rationale, evidence FROM cued"


@query(CUED + f" {SAID}")
def labels_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message and label asked of the offline provider in batches."""
    return verdicts.ask(verdicts.fan_out(_student(spark, sf_dir), _cued(spark)))


def _fails_on_some(rows: pd.DataFrame) -> pd.DataFrame:
    if (rows["k"] % 10 == 6).any():
        raise OSError("the service is away")
    return verdicts.offline(rows)


CONCEPTS = (("groupby", "splitting tables"), ("question", "exercises"))
FACETS = CUED + LATENCY + f""", said AS ({SAID}), none AS (SELECT chatlog_id, message_index, bool_and(NOT applies) AS none FROM said GROUP BY ALL),
facets AS (SELECT t.chatlog_id, t.turn_index AS message_index, n.none AS no_label_fits, CASE WHEN n.none THEN 'none of the cues in ' || length(t.text) || ' characters' ELSE '' END AS coverage_note,
  CASE WHEN contains(lower(t.text), 'failing') THEN 'pasted-error' ELSE 'authored-question' END AS forms, array_to_string(list_filter(['groupby', 'question'], lambda c: contains(lower(t.text), c)), ',') AS concepts,
  CASE b.latency_bucket WHEN 'conversation-opening' THEN 'initiates-new-topic' WHEN 'rapid' THEN 'responds-to-tutor' ELSE 'continues-own-thread' END AS move
  FROM turns t JOIN none n ON n.chatlog_id = t.chatlog_id AND n.message_index = t.turn_index JOIN bucketed b ON b.conv_id = t.conv_id AND b.turn_index = t.turn_index WHERE t.role = 'student')"""


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student turns with what a provider is told: the turns around them, the wait, the mode."""
    t = turns.with_latency(turns.with_context(E.assemble_turns(D.log(spark, sf_dir), extra=("k",)))).filter("role = 'student'")
    m = t.select("chatlog_id", F.col("turn_index").cast("int").alias("message_index"), "text", "k", "mode", "context", "context_after", "latency_seconds", "latency_bucket")
    return m.withColumn("shown", labeling.shown(m, BEFORE))


def _with_facets(rows: DataFrame) -> DataFrame:
    joined = {c: F.array_join(c, ",") for c in ("forms", "concepts")}
    return labeling.as_long(rows, "no_label_fits", "coverage_note", "forms", "concepts", "move").withColumns(joined)


@query(FACETS + " SELECT s.*, no_label_fits, coverage_note, forms, concepts, move FROM said s JOIN facets USING (chatlog_id, message_index)")
def labels_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose provider fails on some messages, and a second one that asks only for what the first left."""
    folder, messages, labels = fresh_folder(spark, "verdicts"), settled(_described(spark, sf_dir)), _cued(spark)
    try:
        labeling.label_messages(spark, messages, labels, folder, "v1", _fails_on_some, attempts=1, each=4, concepts=CONCEPTS)
    except labeling.LabelingError:
        pass  # what was finished is stored
    return _with_facets(labeling.label_messages(spark, messages, labels, folder, "v1", concepts=CONCEPTS))


def _reads_prompts(rows: pd.DataFrame) -> pd.DataFrame:
    """A provider that looks at nothing but the prompt: whether the turns before a message hold a reply, and what the prompt says of the wait."""
    waits = [p.split("Wait since the tutor's last turn: ")[1].split("\n")[0] for p in rows["prompt"]]
    before = [p.split("Turns before:\n")[1].split("\nWait since")[0] for p in rows["prompt"]]
    return pd.DataFrame({
        "applies": ["tutor: " in b for b in before], "rationale": waits, "evidence": "",
        "no_label_fits": [b == "(conversation start)" for b in before], "note": "opening", "move": "responds-to-tutor", "forms": [["nudge", "made up"]] * len(rows),
    })


@query(TURNS + LATENCY + """, w AS (SELECT conv_id, turn_index, chatlog_id, role, count(CASE WHEN role = 'tutor' THEN 1 END) OVER x AS replies, count(*) OVER x AS n FROM turns WINDOW x AS (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT w.chatlog_id, w.turn_index AS message_index, replies > 0 AS applies, CASE WHEN opening THEN '(conversation opening)' WHEN latency_seconds IS NULL THEN '(unknown)' ELSE '(' || latency_bucket || ')' END AS wait, n = 0 AS no_label_fits, CASE WHEN n = 0 THEN 'opening' ELSE '' END AS coverage_note, 'nudge' AS forms
FROM w JOIN bucketed USING (conv_id, turn_index) WHERE w.role = 'student'""")
def prompts_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider reads in the prompts of messages: context, wait, and typed answers about coverage."""
    rows = labeling.label_messages(spark, _described(spark, sf_dir), _cued(spark).limit(1), fresh_folder(spark, "verdicts"), "v1", _reads_prompts)
    long = labeling.as_long(rows, "no_label_fits", "coverage_note", "forms")
    wait = F.concat(F.lit("("), F.substring_index("rationale", "(", -1))
    return long.select(*sampling.KEY, "applies", wait.alias("wait"), "no_label_fits", "coverage_note", F.array_join("forms", ",").alias("forms"))


def _draws(rows: pd.DataFrame) -> pd.DataFrame:
    """A provider whose answer turns by a fixed coin for each run, as a sampled model's would."""
    coin = [int(hashlib.md5(f"vote{r}:{c}:{m}:{label}".encode()).hexdigest()[:6], 16) % (r + 5) == 0 for r, c, m, label in zip(rows["run"], rows["chatlog_id"], rows["message_index"], rows["label"], strict=True)]
    return pd.DataFrame({"applies": [a != c for a, c in zip(rows["applies"], coin, strict=True)], "rationale": "", "evidence": ""})


@query(ENTROPY + " SELECT label, run, count(*) AS n, count(CASE WHEN applies THEN 1 END) AS yes FROM votes GROUP BY ALL")
def votes_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five votes for each message and label at a temperature, counted."""
    pairs = D.verdicts(spark, sf_dir).select("chatlog_id", F.col("message_index").cast("int").alias("message_index"), "label", "applies")
    drawn = verdicts.votes(pairs, _draws, verdicts.Sampling(runs=5))
    return drawn.groupBy("label", "run").agg(F.count("*").alias("n"), F.count(F.when(F.col("applies"), 1)).alias("yes"))


SPARSE = AUDIT + """, model AS (SELECT * FROM verdicts WHERE applies OR label = 'confused')
SELECT a.label, count(CASE WHEN a.applies AND coalesce(m.applies, false) THEN 1 END) AS tp, count(CASE WHEN NOT a.applies AND coalesce(m.applies, false) THEN 1 END) AS fp,
  count(CASE WHEN a.applies AND NOT coalesce(m.applies, false) THEN 1 END) AS fn, count(CASE WHEN NOT a.applies AND NOT coalesce(m.applies, false) THEN 1 END) AS tn
FROM audit a LEFT JOIN model m USING (chatlog_id, message_index, label) GROUP BY a.label"""


@query(SPARSE)
def confusion_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model table that lacks most labels that do not apply: what it lacks counts as not applied."""
    model = D.verdicts(spark, sf_dir).filter(F.col("applies") | (F.col("label") == "confused"))
    return quality.confusion(D.audit(spark, sf_dir, 0), model).select("label", "tp", "fp", "fn", "tn")


@query(VERDICTS + f", a AS (SELECT chatlog_id, message_index, label, applies <> ({_flip('ablated', 8)}) AS after FROM verdicts), f AS (SELECT chatlog_id, message_index, bool_or(after <> applies) AS flipped FROM verdicts JOIN a USING (chatlog_id, message_index, label) GROUP BY ALL) SELECT count(*) AS messages, count(CASE WHEN flipped THEN 1 END) AS messages_with_flips FROM f")
def ablation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.verdicts(spark, sf_dir)
    return quality.messages_with_flips(v, v.withColumn("applies", F.col("applies") != D.flips("ablated", 8)))


@query(VERDICTS + ", audits AS (" + " UNION ALL ".join(f"SELECT {i} AS annotator, chatlog_id, message_index, label, applies <> ({_flip(f'human{i}', 6 + i)}) AS applies FROM verdicts WHERE NOT ({_flip(f'judged{i}', 3)})" for i in range(3)) + """),
common AS (SELECT chatlog_id, message_index, label FROM audits GROUP BY ALL HAVING count(DISTINCT annotator) = 3),
h AS (SELECT a.* FROM audits a JOIN common USING (chatlog_id, message_index, label)),
i AS (SELECT x.annotator, x.chatlog_id, x.message_index, count(CASE WHEN v.applies = y.applies THEN 1 END) AS model, count(CASE WHEN x.applies = y.applies THEN 1 END) AS human
  FROM h x JOIN h y USING (chatlog_id, message_index, label) JOIN verdicts v USING (chatlog_id, message_index, label) WHERE x.annotator <> y.annotator GROUP BY ALL),
w AS (SELECT annotator, count(CASE WHEN model >= human THEN 1 END) / count(*) >= 0.4 AS wins FROM i GROUP BY annotator)
SELECT count(CASE WHEN wins THEN 1 END) * 2 > count(*) AS passes, count(*) AS annotators FROM w""")
def alt_test_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the model wins against a strict majority of annotators."""
    return quality.alt_test_passes(quality.alt_test(D.audits(spark, sf_dir, 0, 1, 2), D.verdicts(spark, sf_dir), Params.alt_test_epsilon))


@query(HEADS + " SELECT count(CASE WHEN started_us IS NULL THEN 1 END) AS undated FROM heads")
def undated_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.undated(E.heads(D.log(spark, sf_dir)))


FETCHED = TURNS + f", picked AS (SELECT * FROM heads ORDER BY md5('{SEED}:' || chatlog_id), chatlog_id LIMIT 200)"


@query(FETCHED + " SELECT p.conv_id, p.chatlog_id, p.notebook, p.started_us, count(*) AS n_turns FROM picked p JOIN turns t USING (conv_id) GROUP BY ALL")
def fetched_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 200 heads with their turns; those without turns have counted and are dropped."""
    heads, found = E.fetch(D.log(spark, sf_dir), 200, sample_seed=SEED)
    return heads.join(found.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "conv_id").select("conv_id", "chatlog_id", "notebook", "started_us", "n_turns")


@query(LOG + " SELECT event_id, us, CAST(user_key AS VARCHAR) AS user_key, event_type, conv_id, notebook, question, response, mode, grader_id, success, notebook_json FROM log")
def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as raw rows with a JSON payload, and parsed again."""
    log = D.log(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("conv_id").alias("conversation_id"), "notebook", "question", "response", "mode", "grader_id", "success", F.col("notebook_json").alias("initial_notebook_json")))
    raw = log.select(F.col("event_id").alias("id"), "event_type", F.timestamp_micros("us").alias("created_at"), F.col("user_key").cast("string").alias("user_email"), payload.alias("payload"))
    return E.parse(raw)


@query(FACTS + " SELECT chatlog_id, message_index, '' AS pre_pattern, '' AS last_run_grader, question_ref = '' AS no_ref, '' AS mode, '' AS seq_granularity, false AS snapshot_traceback, text FROM facts")
def sequence_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the ablation without sequence facts sees them; references to questions stay."""
    f = verdicts.without_sequence(_facts(spark, sf_dir))
    return f.select("chatlog_id", "message_index", "pre_pattern", "last_run_grader", (F.col("question_ref") == "").alias("no_ref"), "mode", "seq_granularity", "snapshot_traceback", "text")


@query(TURNS + """, f AS (SELECT chatlog_id, turn_index AS message_index, k, k % 2 <> 0 AND k % 3 <> 0 AND k % 5 = 0 AS none,
  [CASE WHEN k % 2 = 0 THEN 'nudge' ELSE 'odd' END, 'other', CASE WHEN k % 3 = 0 THEN 'nudge' ELSE 'pasted-error' END] AS forms, ['c' || (k % 4), 'c1'] AS concepts, CASE WHEN k % 3 = 0 THEN 'responds-to-tutor' ELSE 'jumps' END AS move FROM turns WHERE role = 'student')
SELECT chatlog_id, message_index, array_to_string(list_filter(forms, lambda x: x <> 'odd'), ',') AS forms, array_to_string(list_filter(concepts, lambda x: x IN ('c1', 'c2')), ',') AS concepts,
  CASE WHEN move = 'jumps' THEN '' ELSE move END AS move, CASE WHEN none THEN 'note ' || k ELSE '' END AS coverage_note FROM f""")
def facets_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form facets cut to their taxonomies."""
    k, lit = F.col("k"), F.lit
    raw = _student(spark, sf_dir).select(
        "chatlog_id", "message_index", D.abstains().alias("no_label_fits"), F.concat(lit("note "), k).alias("coverage_note"),
        F.array(F.when(k % 2 == 0, "nudge").otherwise("odd"), lit("other"), F.when(k % 3 == 0, "nudge").otherwise("pasted-error")).alias("forms"),
        F.array(F.concat(lit("c"), k % 4), lit("c1")).alias("concepts"), F.when(k % 3 == 0, "responds-to-tutor").otherwise("jumps").alias("move"),
    )
    f = verdicts.filtered_facets(raw, ["c1", "c2"])
    return f.select("chatlog_id", "message_index", F.array_join("forms", ",").alias("forms"), F.array_join("concepts", ",").alias("concepts"), "move", "coverage_note")


@query(VERDICTS + " SELECT chatlog_id, message_index, label, applies, rationale FROM verdicts")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts emitted as a snapshot and read back."""
    v = D.verdicts(spark, sf_dir).select(*sampling.KEY, "label", "applies", "rationale", F.lit("").alias("evidence"))
    path = snapshot.emit(spark, fresh_folder(spark, "snapshots"), "s", {"labels": verdicts.as_maps(v)}, {"labels": []}, {"schema_version": "v1"})
    back = snapshot.read_labels(spark, f"{path}/labels.jsonl")
    return back.select(*sampling.KEY, F.explode("labels").alias("label", "applies"), "rationales").select(*sampling.KEY, "label", "applies", F.col("rationales")[F.col("label")].alias("rationale"))


_DRAWN = f"SELECT chatlog_id, message_index FROM verdicts WHERE label_ord = 0 ORDER BY md5('{SEED}:' || chatlog_id || ':' || message_index), chatlog_id, message_index LIMIT 40"


@query(AUDIT + f", s AS ({_DRAWN}) SELECT chatlog_id, message_index, label, applies FROM audit SEMI JOIN s USING (chatlog_id, message_index)")
def audit_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotator's judgments of 40 sampled messages, submitted as a file and read back."""
    drawn = D.messages(spark, sf_dir).orderBy(sampling.drawn(SEED, *sampling.KEY), *sampling.KEY).limit(40).select(*sampling.KEY)
    answers = D.audit(spark, sf_dir, 0).join(F.broadcast(drawn), list(sampling.KEY), "left_semi")
    path = audit.submit(spark, answers, fresh_folder(spark, "audits"), "a")
    return snapshot.read_audit(spark, path).select(*sampling.KEY, "label", "applies")


@query(VERDICTS + f", s AS ({_DRAWN}) SELECT chatlog_id, message_index, coalesce(string_agg(label || ': ' || rationale, '; ' ORDER BY label) FILTER (WHERE applies), '') AS applied, bool_or(no_label_fits) AS no_label_fits FROM verdicts SEMI JOIN s USING (chatlog_id, message_index) GROUP BY ALL")
def audit_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 40 sampled messages show after the answers are submitted: labels that apply, and why."""
    drawn = D.messages(spark, sf_dir).orderBy(sampling.drawn(SEED, *sampling.KEY), *sampling.KEY).limit(40).select(*sampling.KEY)
    shown = audit.revealed(drawn, D.verdicts(spark, sf_dir))
    said = F.array_join(F.transform("applied", lambda a: F.concat(a["label"], F.lit(": "), a["rationale"])), "; ")
    return shown.select(*sampling.KEY, said.alias("applied"), "no_label_fits")


@query("""WITH c AS (SELECT n_nationkey AS ord, n_name AS name, 'about ' || lower(n_name) AS description, n_regionkey = 1 AS promoted FROM nation), r AS (SELECT r_regionkey AS ord, r_name AS name, 'all of ' || lower(r_name) AS description FROM region)
SELECT (SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY ord) FROM r) AS labels_block, (SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY ord) FROM c WHERE NOT promoted) AS concepts_block,
  (SELECT string_agg('- ' || name || ': ' || description || ' | applies: mentions ' || name, chr(10) ORDER BY layer, ord) FROM (SELECT 0 AS layer, * EXCLUDE promoted FROM c WHERE promoted UNION ALL SELECT 1, * FROM r)) AS covered_block,
  'Course: a domain' || chr(10) || 'Tooling: t' || chr(10) || 'Pasted material: p' || chr(10) || 'Assignment references: r' || chr(10) || 'Message shape: m' || chr(10) || 'Course concepts: ' || (SELECT string_agg(name, ', ' ORDER BY ord) FROM c) AS course_context""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of a prompt from tables of concepts and labels."""
    says = lambda df, key, name, about: df.select(F.col(key).alias("ord"), F.col(name).alias("name"), F.concat(F.lit(about), F.lower(name)).alias("description"), F.concat(F.lit("mentions "), name).alias("positive_criteria"), *([(F.col("n_regionkey") == 1).alias("promoted")] if key == "n_nationkey" else []))
    concepts = says(D.read(spark, sf_dir, "nation"), "n_nationkey", "n_name", "about ")
    labels = says(D.read(spark, sf_dir, "region"), "r_regionkey", "r_name", "all of ")
    course = spark.createDataFrame([("Course", "a domain", "t", "p", "r", "m")], "course_name string, domain_description string, tooling string, paste_conventions string, reference_conventions string, message_shape_notes string")
    return prompts.labels_block(labels).crossJoin(prompts.concepts_block(concepts)).crossJoin(prompts.covered_block(concepts, labels)).crossJoin(prompts.course_context(course, concepts))


@query(TURNS + " SELECT text, min(event_id) AS event_id FROM turns WHERE role = 'student' GROUP BY text")
def first_seen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct student texts with the event in which each first appears."""
    return sampling.first_seen(E.assemble_turns(D.log(spark, sf_dir)).filter("role = 'student'"), "text", "event_id")


#: States of a trajectory: the first label that applies to a message, or none.
STATES = (*D.LABELS, "other")
_FIRST = "CASE " + " ".join(f"WHEN k % {n} = 0 THEN '{label}'" for label, n in D.LABELS.items()) + " ELSE 'other' END"
STEPS = TURNS + f""", placed AS (SELECT conv_id, turn_index, {_FIRST} AS state FROM turns WHERE role = 'student'),
steps AS (SELECT conv_id, state, next_state, count(*) AS n FROM (SELECT conv_id, state, lead(state) OVER (PARTITION BY conv_id ORDER BY turn_index) AS next_state FROM placed) WHERE next_state IS NOT NULL GROUP BY ALL)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.coalesce(*[F.when(F.col("k") % n == 0, label) for label, n in D.LABELS.items()], F.lit("other"))
    return trajectories.transitions(D.messages(spark, sf_dir).select("conv_id", F.col("message_index").alias("turn_index"), state.alias("state")))


@query(STEPS + f", total AS (SELECT conv_id, sum(n) AS n FROM steps GROUP BY conv_id) SELECT s.conv_id, s.state, s.next_state, CAST((2 * {trajectories.UNIT} * s.n + t.n) // (2 * t.n) AS BIGINT) AS share FROM steps s JOIN total t USING (conv_id)")
def trajectory_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every conversation's transition vector that are not zero, in ten-thousandths."""
    v = trajectories.vectors(_steps(spark, sf_dir), STATES)
    names = F.array(*[F.struct(F.lit(a).alias("state"), F.lit(b).alias("next_state")) for a in STATES for b in STATES])
    return v.select("conv_id", F.posexplode("v").alias("at", "share")).filter("share > 0").select("conv_id", F.get(names, F.col("at"))["state"].alias("state"), F.get(names, F.col("at"))["next_state"].alias("next_state"), "share")


@query(None)
def trajectory_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four archetypes of conversations, with their sizes and most frequent transitions; k-means has no SQL, so plain Python tests it."""
    return trajectories.archetypes(_steps(spark, sf_dir), STATES, 4)[1].filter("share > 0")


@query(STEPS + f", total AS (SELECT conv_id, sum(n) AS n FROM steps GROUP BY conv_id) SELECT count(*) AS conversations, true AS all_placed, true AS nearest FROM total")
def trajectory_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That every conversation with transitions is in one archetype, and in none that is not the nearest."""
    members, table = trajectories.archetypes(_steps(spark, sf_dir), STATES, 4)
    centre = table.groupBy("archetype").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(f"{a}>{b}") for a in STATES for b in STATES]), F.concat("state", F.lit(">"), "next_state")).alias("at"), F.round(F.col("share") * trajectories.UNIT).cast("bigint").alias("x")))), lambda e: e["x"]).alias("c"))
    own = trajectories.vectors(_steps(spark, sf_dir), STATES).crossJoin(F.broadcast(centre)).groupBy("conv_id").agg(F.min(trajectories._distance(F.col("v"), F.col("c"))).alias("least"))
    checked = members.join(own, "conv_id", "full")
    return checked.agg(F.count("*").alias("conversations"), F.bool_and(F.col("archetype").isNotNull()).alias("all_placed"), F.bool_and(F.col("distance") == F.col("least")).alias("nearest"))


GAP = 6 * 3600  # seconds; the synthetic log is sparse
_SESSIONS = f"""cut AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_key ORDER BY us, event_id) <= {GAP * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM log),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_key ORDER BY us, event_id) AS session FROM cut)"""


@query(LOG + f""", {_SESSIONS} SELECT user_key, min(us) AS started_us, max(us) AS ended_us, count(*) AS n_events, count(CASE WHEN event_type = 'tutor_query' THEN 1 END) AS n_messages,
  count(CASE WHEN event_type = 'autograder_info' THEN 1 END) AS n_runs, count(CASE WHEN event_type = 'autograder_info' AND success = 'true' THEN 1 END) AS n_passed FROM numbered GROUP BY user_key, session""")
def study_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students' sessions, parted by gaps of more than six hours."""
    return sessions.study_sessions(D.log(spark, sf_dir), f"{GAP} seconds")


@query(TURNS + LATENCY + f""", f AS (SELECT min(started_us) AS first_us FROM heads),
m AS (SELECT t.chatlog_id, ((h.started_us - f.first_us) // 86400000000) // 7 AS week FROM turns t JOIN heads h USING (chatlog_id), f WHERE t.role = 'student')
SELECT CAST(week AS BIGINT) AS week, count(*) AS n, true AS messages_hold, true AS conversations_hold, true AS waits_hold FROM m GROUP BY week UNION ALL SELECT NULL, count(*), true, true, true FROM m""")
def weekly_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by week and, merged from these alone, of all weeks (null): whether their estimates are within the stated errors of the exact values."""
    log = D.log(spark, sf_dir)
    t = turns.with_latency(E.assemble_turns(log)).filter("role = 'student'")
    m = t.select("chatlog_id", F.col("turn_index").alias("message_index"), "latency_seconds").join(turns.conversation_weeks(E.heads(log)).select("chatlog_id", "week"), "chatlog_id")
    by_week = settled(sketches.sketched(m, "week"))
    all_weeks = sketches.merged(by_week).withColumn("week", F.lit(None).cast("bigint"))
    said = sketches.estimates(by_week.unionByName(all_weeks), 0.5)
    both = m.unionByName(m.withColumn("week", F.lit(None).cast("bigint")))
    wait = F.get("waits", F.lit(0))
    # the share of waits below and up to the estimated median shows its rank
    exact = both.join(said.select(F.col("week").alias("w"), F.col("waits")), F.col("week").eqNullSafe(F.col("w"))).groupBy("week").agg(
        F.countDistinct("chatlog_id", "message_index").alias("m"), F.countDistinct("chatlog_id").alias("c"),
        F.avg((F.col("latency_seconds") < wait).cast("double")).alias("below"), F.avg((F.col("latency_seconds") <= wait).cast("double")).alias("upto"),
    ).withColumnRenamed("week", "w")
    near = lambda estimate, value: F.abs(F.col(estimate) - F.col(value)) <= F.greatest(F.lit(0.5), sketches.COUNT_ERROR * F.col(value))
    waits = F.coalesce((F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR), F.lit(True))
    joined = said.join(exact, F.col("week").eqNullSafe(F.col("w")))
    return joined.select("week", "n", near("n_messages", "m").alias("messages_hold"), near("n_conversations", "c").alias("conversations_hold"), waits.alias("waits_hold"))


_BANDS = ", ".join("md5(" + " || '|' || ".join(f"list_min(list_transform(words, lambda w: md5('{b}:{r}:' || w)))" for r in range(clusters.ROWS)) + ")" for b in range(clusters.BANDS))


@query(VERDICTS.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f""", m AS (SELECT chatlog_id, message_index, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS words FROM verdicts WHERE label_ord = 0 AND no_label_fits),
t AS MATERIALIZED (SELECT md5(array_to_string(words, ' ')) AS id, words, count(*) AS n FROM m WHERE len(words) > 0 GROUP BY words),
s AS (SELECT id, words, n, unnest(generate_series(1, {clusters.BANDS})) AS b, unnest([{_BANDS}]) AS signature FROM t),
d AS (SELECT b, signature, min(id) AS hub FROM s GROUP BY b, signature HAVING sum(n) >= {clusters.LEAST} AND count(*) > 1),
l AS MATERIALIZED (SELECT DISTINCT d.hub AS a, s.id AS b FROM s JOIN d USING (b, signature) JOIN t h ON h.id = d.hub WHERE s.id <> d.hub AND 100 * len(list_intersect(s.words, h.words)) >= {clusters.PERCENT} * len(list_distinct(list_concat(s.words, h.words)))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id AS a, id AS c FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a AS id, min(c) AS cluster FROM r GROUP BY a)
SELECT cluster, CAST(sum(n) AS BIGINT) AS n_messages, count(*) AS n_texts FROM c JOIN t USING (id) GROUP BY cluster HAVING sum(n) >= {clusters.LEAST}""")
def abstention_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What messages that no label fits have in common: clusters of like texts."""
    none = D.messages(spark, sf_dir).filter(D.abstains())
    return clusters.described(clusters.clusters(none)).select("cluster", "n_messages", "n_texts")


def _once_more(rows: pd.DataFrame) -> pd.DataFrame:
    """A provider that has no answer at the first time of asking."""
    asked = _once_more.__dict__.setdefault("asked", set())
    key = (rows["chatlog_id"].iloc[0], rows["message_index"].iloc[0], rows["label"].iloc[0], len(rows))
    if key not in asked:
        asked.add(key)
        raise OSError("busy")
    return verdicts.offline(rows)


@query(CUED + f" {SAID}")
def labels_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message and label asked of a provider that fails once on each call."""
    return verdicts.ask(verdicts.fan_out(_student(spark, sf_dir), _cued(spark)), _once_more, base_seconds=0)


@query("SELECT n_name AS name, n_regionkey = 1 AS promoted FROM nation WHERE n_regionkey <> 0")
def profile_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts after a review: some deleted, some promoted."""
    nation = D.read(spark, sf_dir, "nation")
    names = {r: [x["n_name"] for x in nation.filter(F.col("n_regionkey") == r).collect()] for r in (0, 1)}
    return accept_profile(nation.select(F.col("n_name").alias("name")), names[0], names[1])


_PLACED = "t.tercile || '/' || CASE WHEN u.student_index < t.n_student / 2.0 THEN 'early' ELSE 'late' END"


@query(TURNS.replace("GROUP BY conv_id),\nflagged", "GROUP BY conv_id ORDER BY min(event_id) LIMIT 40),\nflagged") + TERCILES + f""", s AS (SELECT u.chatlog_id, u.turn_index AS message_index, u.text, {_PLACED} AS stratum FROM turns u JOIN terciles t USING (conv_id) WHERE u.role = 'student'),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || chatlog_id || ':' || message_index), chatlog_id, message_index) AS rn FROM s)
SELECT chatlog_id, message_index, text, {WORDS}[split_part(stratum, '/', 1)] || ' · ' || {WORDS}[split_part(stratum, '/', 2)] AS stratum FROM (SELECT * FROM r ORDER BY rn, r.stratum LIMIT 9)""")
def peeked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session shows before anything is kept: nine messages of its first 40 conversations, a stratum in turn."""
    return Session(spark, D.log(spark, sf_dir), fresh_folder(spark, "session"), _no_draft).peek(9)


def _no_draft(intent: str, digest: str) -> tuple[Label, ...]:
    return ()


def _cue_labels(intent: str, digest: str) -> tuple[Label, ...]:
    return tuple(Label(name, cues=cues) for name, cues in CUES)


@query(FACTS + LATENCY + DEFECT + f""", cued AS (SELECT chatlog_id, turn_index AS message_index, k, c.label, CASE WHEN contains(lower(text), c.one) THEN c.one WHEN contains(lower(text), c.two) THEN c.two ELSE '' END AS evidence
  FROM turns, (VALUES ('failing', 'keeps failing', 'keeps failing'), ('lost', 'stuck', 'broken'), ('numbers', 'question', 'question')) c(label, one, two) WHERE role = 'student'),
said AS (SELECT chatlog_id, message_index, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE evidence <> ''), '') AS applied, bool_and(evidence = '') AS no_label_fits FROM cued GROUP BY ALL)
SELECT f.chatlog_id, f.message_index, applied, no_label_fits, CASE WHEN contains(lower(f.text), 'failing') THEN 'pasted-error' ELSE 'authored-question' END AS forms,
  CASE b.latency_bucket WHEN 'conversation-opening' THEN 'initiates-new-topic' WHEN 'rapid' THEN 'responds-to-tutor' ELSE 'continues-own-thread' END AS move, f.mode, b.latency_bucket,
  coalesce(m.mode = 'chatgpt' AND m.mode_before = 'tutor', false) AS defected, question_ref, pre_pattern, seq_granularity, pre_pattern <> 'ask-first' AS attempted, snapshot_traceback OR coalesce(NOT last_run_success, false) AS error_verified
FROM facts f JOIN said USING (chatlog_id, message_index) JOIN bucketed b ON b.conv_id = f.conv_id AND b.turn_index = f.message_index JOIN modes m ON m.conv_id = f.conv_id AND m.turn_index = f.message_index""")
def session_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole session: drafted, reviewed on a stratified sample, accepted; the snapshot's label rows with facets and facts."""
    s = Session(spark, settled(D.log(spark, sf_dir)), fresh_folder(spark, "session"), _cue_labels, params=Params(before_minutes=BEFORE, outcome_minutes=AFTER))
    s.start("what is hard")
    s.review(12).count()
    rows = snapshot.read_labels(spark, f"{s.accept()}/labels.jsonl")
    joined = {"applied": F.array_join(F.array_sort(verdicts.applied(F.col("labels"))), ","), "forms": F.array_join("forms", ",")}
    return rows.withColumns(joined).select("chatlog_id", "message_index", "applied", "no_label_fits", "forms", "move", "mode", "latency_bucket", "defected", "question_ref", "pre_pattern", "seq_granularity", "attempted", "error_verified")


@query("SELECT item_id, substr(text || chr(10), 1, 200) AS text FROM benchmark")
def materials_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course materials, one file each, cut to 200 characters."""
    folder = fresh_folder(spark, "materials")
    D.read(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(folder)
    return snapshot.read_materials(spark, f"{folder}/*", 200).select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), "text")


@query("SELECT 'concepts.' || n_name || '.' || field AS where_, CASE field WHEN 'name' THEN n_name WHEN 'description' THEN 'about ' || n_name ELSE '' END AS text FROM nation, (VALUES ('name'), ('description'), ('positive_criteria'), ('negative_criteria')) f(field) UNION ALL SELECT 'course', 'world'")
def profile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile saved and loaded, and every string that its explorer wrote."""
    names = [r["n_name"] for r in D.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    path = Profile("world", tuple(Concept(n, f"about {n}") for n in names)).save(spark, f"{fresh_folder(spark, 'profiles')}/world.json")
    return Profile.load(spark, path).artifacts(spark).withColumnRenamed("where", "where_")
