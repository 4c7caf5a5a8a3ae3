"""A labeling session over DataFrames: fetch, draft, review, label all, emit a snapshot.

The session is a small driver object; what it holds are DataFrames and a handful of label
definitions. Drafting and verdicts come from injected functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.functions import prompts
from tutorlens.functions.text import plain_stratum, question_ref
from tutorlens.operators import labeling, profile, sampling, sequences, summary, turns, verdicts
from tutorlens.params import CRITERION_WORDS, DESCRIPTION_WORDS, FORMS, MOVES, Params, content_hash
from tutorlens.sources import events, snapshot
from tutorlens.sources.shared import settled

#: Conversations that a peek reads, and files of materials that an explorer is given (20,000 characters each).
PEEK_CONVERSATIONS, MATERIALS = 40, 50
#: What the facts of test runs are made from; a log without these columns has no such facts.
RUN_COLUMNS = {"grader_id", "success", "notebook_json"}


class PhaseError(RuntimeError):
    """The call does not fit the session's phase."""


@dataclass(frozen=True)
class Label:
    name: str
    description: str = ""
    positive_criteria: str = ""
    negative_criteria: str = ""
    cues: str = ""


@dataclass(frozen=True)
class Schema:
    intent: str
    labels: tuple[Label, ...]
    parent_version: str = ""

    @property
    def version(self) -> str:
        return content_hash({"intent": self.intent, "labels": [vars(x) for x in self.labels], "parent": self.parent_version})

    def revised(self, labels: tuple[Label, ...]) -> Schema:
        return Schema(self.intent, labels, self.version)


def oversized(labels: tuple[Label, ...]) -> list[str]:
    """Fields with more words than their cap, as 'label.field (nw > capw)'."""
    caps = (("description", DESCRIPTION_WORDS), ("positive_criteria", CRITERION_WORDS), ("negative_criteria", CRITERION_WORDS))
    return [f"{x.name}.{f} ({n}w > {cap}w)" for x in labels for f, cap in caps if (n := len(getattr(x, f).split())) > cap]


SHORTER = "\nKeep every field short."


def _within_caps(draft: Callable[[str], object], said: str, findings: Callable[[object], list[str]]) -> object:
    """What `draft` returns; where that breaks the caps it is asked again once, then refused."""
    for text in (said, said + SHORTER):
        out = draft(text)
        if not (found := findings(out)):
            return out
    raise ValueError("the draft breaks the caps: " + "; ".join(found))


def drafted(draft: Callable[[str, str], tuple[Label, ...]], intent: str, digest: str) -> tuple[Label, ...]:
    """Labels from the drafting function, within the caps."""
    return _within_caps(lambda text: draft(intent, text), digest, oversized)


@dataclass(frozen=True)
class Concept:
    name: str
    description: str = ""
    positive_criteria: str = ""
    negative_criteria: str = ""
    promoted: bool = False


#: The criteria that a concept gets when it is promoted without any.
ENGAGES = "The student message substantively engages {0} ({1})"
INCIDENTAL = "{0} appears only incidentally (e.g. inside pasted code or output) without the student engaging it"


@dataclass(frozen=True)
class Profile:
    """What exploring a course found: concepts, and layers of labels that ride below an instructor's own."""

    course: str
    concepts: tuple[Concept, ...] = ()
    affect: tuple[Label, ...] = ()
    intent: tuple[Label, ...] = ()
    accepted: bool = False

    @property
    def version(self) -> str:
        kinds = {"concepts": self.concepts, "affect": self.affect, "intent": self.intent}
        return content_hash({k: [vars(x) for x in v] for k, v in kinds.items()} | {"course": self.course, "accepted": self.accepted})

    def oversized(self) -> list[str]:
        """Fields with more words than their cap, of concepts and of both layers."""
        long = [f"{c.name}.description ({n}w > {DESCRIPTION_WORDS}w)" for c in self.concepts if (n := len(c.description.split())) > DESCRIPTION_WORDS]
        return oversized(self.affect + self.intent) + long

    def taught(self) -> tuple[tuple[str, str], ...]:
        """Names and descriptions of the concepts that are not labels: facets of a message's coverage."""
        return tuple((c.name, c.description) for c in self.concepts if not c.promoted)

    def save(self, spark: SparkSession, path: str) -> str:
        """Writes the profile as JSON, over one that is there, and returns its path."""
        return snapshot.write_json(spark, path, asdict(self) | {"version": self.version})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Profile:
        raw = snapshot.read_json_file(spark, path)
        own = {"concepts": Concept, "affect": Label, "intent": Label}
        return cls(raw["course"], accepted=raw["accepted"], **{k: tuple(kind(**x) for x in raw[k]) for k, kind in own.items()})

    def layers(self) -> tuple[Label, ...]:
        on = tuple(Label(c.name, c.description, c.positive_criteria, c.negative_criteria) for c in self.concepts if c.promoted)
        return on + self.affect + self.intent

    def artifacts(self, spark: SparkSession) -> DataFrame:
        """(where, text) of every string that an explorer wrote."""
        rows = [(f"{kind}.{x.name}.{f}", getattr(x, f)) for kind in ("concepts", "affect", "intent") for x in getattr(self, kind) for f in ("name", "description", "positive_criteria", "negative_criteria")]
        return spark.createDataFrame([*rows, ("course", self.course)], "where string, text string")

    def revised(self, deleted: dict[str, list[str]], promoted: list[str]) -> Profile:
        """Accepted, without what is deleted, with concepts promoted; a name in two layers is refused."""
        left = {k: tuple(x for x in getattr(self, k) if x.name not in deleted.get(k, ())) for k in ("concepts", "affect", "intent")}
        lifted = lambda c: replace(c, promoted=True, positive_criteria=c.positive_criteria or ENGAGES.format(c.name, c.description), negative_criteria=c.negative_criteria or INCIDENTAL.format(c.name))
        left["concepts"] = tuple(lifted(c) if c.name in promoted else c for c in left["concepts"])
        out = replace(self, accepted=True, **left)
        ensure_distinct(out.layers(), "across layers")
        return out


def ensure_distinct(labels: tuple[Label, ...], where: str) -> None:
    if twice := sorted(n for n, k in Counter(x.name for x in labels).items() if k > 1):
        raise ValueError(f"label name collision {where}: " + ", ".join(twice))


def described(log: DataFrame, found: DataFrame, params: Params = Params(), sequence: bool = True) -> DataFrame:
    """Student turns of `found` with what is known of them: the turns around, the wait, the mode, the runs, the stratum, and all of it in words.

    With `sequence`, runs and notebooks are taken from `log`; without, nothing is said of them.
    """
    t = turns.with_defection(turns.with_latency(turns.with_context(found, params.window_turns), params))
    t = turns.with_position(t, turns.length_terciles(t)).filter("role = 'student'")
    ref = question_ref(F.col("text"))
    if sequence:
        runs = sequences.bracket_runs(log, params.before_minutes, params.outcome_minutes)
        t = sequences.message_facts(t, runs, sequences.traceback_flags(log, found), ref)
    else:
        none = {"last_run_minutes": "double", "last_run_success": "boolean", "attempted": "boolean", "error_verified": "boolean"}
        blank = {"pre_pattern": F.lit(""), "seq_granularity": F.lit(""), "last_run_grader": F.lit(""), "snapshot_traceback": F.lit(False)}
        t = t.withColumn("question_ref", ref).withColumns(blank | {c: F.lit(None).cast(kind) for c, kind in none.items()})
    t = t.withColumn("message_index", F.col("turn_index").cast("int"))
    t = t.withColumn("stratum", sequences.stratum(F.col("tercile"), F.col("position"), F.col("pre_pattern"), F.col("defected")))
    return t.withColumn("shown", labeling.shown(t, params.before_minutes))


@dataclass
class Session:
    spark: SparkSession
    log: DataFrame
    folder: str
    draft: Callable[[str, str], tuple[Label, ...]]
    provider: verdicts.Provider = verdicts.offline
    params: Params = field(default_factory=Params)
    wait_seconds: float = 2.0
    phase: str = "idle"
    schema: Schema | None = None
    heads: DataFrame | None = None
    turns: DataFrame | None = None
    error: str = ""
    profile: Profile | None = None
    profile_draft: Profile | None = None
    counts: dict = field(default_factory=dict)
    course: str = ""
    model: str = "offline"
    sequence: bool = True
    _again: Callable[[], object] | None = None

    def _need(self, *phases: str) -> None:
        if self.phase not in phases:
            raise PhaseError(f"needs phase {' or '.join(phases)}, is {self.phase}")

    def start(self, intent: str, limit: int | None = None) -> None:
        """Fetches conversations, drafts labels from a digest of at most 40 of them, and waits for review."""
        self._need("idle", "error")
        self._run(lambda: self._start(intent, limit))

    def _run(self, job: Callable[[], object]) -> object:
        """Runs a job that ends in a phase of its own; a failure leaves the phase `error`, and `retry` runs it again."""
        try:
            self._again, self.error = job, ""
            return job()
        except Exception as broken:
            self.phase, self.error = "error", str(broken)
            raise

    def retry(self) -> object:
        self._need("error")
        if self._again is None:
            raise PhaseError("nothing to retry")
        return self._run(self._again)

    def peek(self, n: int = 6) -> DataFrame:
        """Between 1 and 12 messages of at most 40 conversations, with their strata in words; nothing is kept."""
        self._need("idle")
        heads, t = events.fetch(self.log, PEEK_CONVERSATIONS)
        placed = turns.with_position(t, turns.length_terciles(t)).filter("role = 'student'").withColumn("message_index", F.col("turn_index").cast("int"))
        placed = placed.withColumn("stratum", F.concat("tercile", F.lit("/"), "position"))
        return sampling.round_robin(placed, min(12, max(1, n)), self.params.seed).select(*sampling.KEY, "text", plain_stratum(F.col("stratum")).alias("stratum"))

    def explore(self, explorer: Callable[[str, list[str]], Profile], materials: DataFrame | None = None, limit: int = 40) -> None:
        """Drafts a profile from a digest of at most `limit` conversations and the materials' texts; then it awaits review."""
        self._need("idle")

        def job() -> None:
            self.phase = "exploring"
            _, t = events.fetch(self.log, limit, sample_seed=self.params.seed)
            text = "\n".join(r["digest"] for r in profile.digest(t).orderBy("conv_id").limit(limit).collect())
            texts = [r["text"] for r in materials.orderBy("path").limit(MATERIALS + 1).collect()] if materials is not None else []
            if len(texts) > MATERIALS:
                raise ValueError(f"more than {MATERIALS} files of materials")
            draft = _within_caps(lambda said: explorer(said, texts), text, Profile.oversized)
            ensure_distilled(draft.artifacts(self.spark), t.filter("role = 'student'").select("text"))
            self.profile_draft, self.turns, self.phase = draft, t, "profile_review"

        self._run(job)

    def accept_profile(self, deleted: dict[str, list[str]] | None = None, promoted: list[str] | None = None) -> Profile:
        """The draft after deletions and promotions, if no name collides and nothing quotes a student; else the review goes on."""
        self._need("profile_review")
        out = self.profile_draft.revised(deleted or {}, promoted or [])
        ensure_distilled(out.artifacts(self.spark), self.turns.filter("role = 'student'").select("text"))
        out.save(self.spark, f"{self.folder}/profiles/{content_hash(out.course)}.json")
        self.profile, self.profile_draft, self.turns, self.phase = out, None, None, "idle"
        return out

    def discard_profile(self) -> None:
        self._need("profile_review", "idle")
        self.profile = self.profile_draft = None
        self.phase = "idle"

    def quit(self) -> None:
        self._need("review", "error", "done", "profile_review")
        self.phase, self.schema, self.heads, self.turns, self.profile_draft, self._again = "idle", None, None, None, None, None

    def _start(self, intent: str, limit: int | None) -> None:
        self.phase = "fetching"
        self.heads, self.turns = events.fetch(self.log, limit, sample_seed=self.params.seed if limit else None)
        self.phase = "drafting"
        some = profile.digest(self.turns).orderBy("conv_id").limit(40)
        text = "\n".join(r["digest"] for r in some.collect())  # 40 conversations, 4 excerpts each
        self.schema = Schema(intent, drafted(self.draft, intent, text))
        self.phase = "review"

    def messages(self) -> DataFrame:
        """Student turns with their facts and strata, as a provider is told of them."""
        m = described(self.log, self.turns, self.params, self.sequence and set(self.log.columns) >= RUN_COLUMNS)
        return m.drop("turn_index", "role", "student_index", "n_student", "event_id")

    def labels(self) -> DataFrame:
        rows = [(i, x.name, x.description, x.positive_criteria, x.negative_criteria, x.cues) for i, x in enumerate(self.schema.labels)]
        return self.spark.createDataFrame(rows, "label_ord int, label string, description string, positive_criteria string, negative_criteria string, cues string")

    @property
    def classifier(self) -> str:
        """What verdicts depend on: labels, course, concepts, parameters, model, taxonomies, and the wording of requests. Verdicts of another one are never taken over."""
        taught = self.profile.taught() if self.profile else ()
        wording = [prompts.label_request(vars(x) | {"label": x.name}, self.course) for x in self.schema.labels] + [prompts.coverage_request([], self.course, taught)]
        return content_hash({"schema": self.schema.version, "params": self.params.version, "model": self.model, "wording": wording, "taxonomies": [FORMS, MOVES], "sequence": self.sequence})

    def _label(self, messages: DataFrame) -> DataFrame:
        """Finished rows of this classifier for `messages`; only those without one are asked for."""
        rows = labeling.label_messages(
            self.spark, messages, self.labels(), f"{self.folder}/verdicts", self.classifier, self.provider, base_seconds=self.wait_seconds, on_progress=self.counts.update,
            course=self.course, concepts=self.profile.taught() if self.profile else (),
        )
        return rows.join(messages.select(*sampling.KEY), list(sampling.KEY), "left_semi")

    def review(self, n: int = 12) -> DataFrame:
        """A sample of every stratum in turn, with the labels that apply and why, for the reviewer. Its verdicts are stored, and count when all is labeled."""
        self._need("review")
        sample = settled(sampling.round_robin(self.messages(), n, self.params.seed))  # read five times
        said = self._label(sample)
        on = F.filter(F.transform(F.map_keys("labels"), lambda k: F.struct(k.alias("label"), F.col("rationales")[k].alias("rationale"), F.col("labels")[k].alias("applies"))), lambda x: x["applies"])
        applied = said.select(*sampling.KEY, F.array_sort(F.transform(on, lambda x: F.struct(x["label"], x["rationale"]))).alias("applied"), "no_label_fits", "coverage_note")
        return sample.select(*sampling.KEY, "conv_id", "text", "mode", "us", plain_stratum(F.col("stratum")).alias("stratum")).join(applied, list(sampling.KEY), "left")

    def tweak(self, labels: tuple[Label, ...]) -> None:
        """Another version of the labels, chained to the one before; verdicts of the one before do not count for it."""
        self._need("review")
        if findings := oversized(labels):
            raise ValueError("; ".join(findings))
        self.schema = self.schema.revised(labels)

    def composed(self) -> Schema:
        """The instructor's labels on top of the accepted profile's layers; a name in two of them is refused."""
        if self.profile is None:
            return self.schema
        labels = self.schema.labels + self.profile.layers()
        ensure_distinct(labels, "in composition")
        return self.schema.revised(labels)

    def accept(self) -> str:
        """Labels every message that this version has not labeled yet and emits a snapshot; returns its path.

        Where the provider fails, what it has finished is kept, and `retry` asks for the rest.
        """
        self._need("review", "error")
        if self.schema is None:
            raise PhaseError("there is no draft")
        return self._run(self._accept)

    def _accept(self) -> str:
        if not (self.schema.parent_version and self.profile and set(self.profile.layers()) <= set(self.schema.labels)):
            self.schema = self.composed()
        self.phase = "mass_labeling"
        messages = settled(self.messages())  # facts of all turns are worked out once
        done = labeling.with_facts(self._label(messages), messages)
        nested = self.turns.groupBy("conv_id", "chatlog_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", "text"))).alias("turns"))
        manifest = {"schema_version": self.schema.version, "params": self.params.version, "classifier": self.classifier, "model": self.model, "profile": self.profile.version if self.profile else None}
        context = {"before_minutes": self.params.before_minutes, "outcome_minutes": self.params.outcome_minutes, "enabled": self.sequence}
        path = snapshot.emit(self.spark, f"{self.folder}/snapshots", self.schema.version, {"conversations": nested, "labels": done}, {"intent": self.schema.intent, "labels": [vars(x) for x in self.schema.labels]}, manifest | {"sequence_context": context})
        self.phase = "done"
        return path

    def back_to_review(self) -> None:
        self._need("done", "error")
        if self.schema is None:
            raise PhaseError("there is no draft")
        self.phase = "review"

    def _stored(self, *keep: str) -> DataFrame:
        return labeling.as_long(labeling.stored(self.spark, f"{self.folder}/verdicts", self.classifier), *keep)

    def summary(self) -> DataFrame:
        """Counts of the labels of the accepted version."""
        self._need("done")
        return summary.prevalence(self._stored("no_label_fits"), self.labels())

    def abstentions(self) -> DataFrame:
        """(abstained, messages, rate) of the accepted version: how often no label fitted."""
        self._need("done")
        return summary.abstention(self._stored("no_label_fits"))

    def abstained(self, n: int = 3) -> DataFrame:
        """The latest messages that no label fits, with the notes about them."""
        self._need("review", "mass_labeling", "done")
        rows = labeling.stored(self.spark, f"{self.folder}/verdicts", self.classifier).filter("no_label_fits").select(*sampling.KEY, "coverage_note")
        return sampling.recent(rows.join(self.messages().select(*sampling.KEY, "text", "us"), list(sampling.KEY)), n)

    def examples(self, label: str, n: int = 5) -> DataFrame:
        """Between 1 and 25 random messages that the label applies to."""
        self._need("done")
        v = self._stored().filter((F.col("label") == label) & F.col("applies"))
        return sampling.example_sample(v.select(*sampling.KEY, "rationale"), self.messages().select(*sampling.KEY, "text"), min(25, max(1, n)), self.params.seed)


def accept_profile(concepts: DataFrame, deleted: list[str], promoted: list[str]) -> DataFrame:
    """The profile's concepts without the deleted ones, and with the promoted ones marked."""
    return concepts.filter(~F.col("name").isin(deleted) if deleted else F.lit(True)).withColumn("promoted", F.col("name").isin(promoted) if promoted else F.lit(False))


def ensure_distilled(artifacts: DataFrame, student: DataFrame, accepted: bool = True) -> None:
    """Refuses a profile that is not accepted, or that quotes a run of student words."""
    if not accepted:
        raise ValueError("the profile is not accepted")
    quoted = [r["where"] for r in profile.lint_overlap(artifacts, student).orderBy("where").limit(5).collect()]
    if quoted:
        raise ValueError("the profile quotes student text: " + ", ".join(quoted))
