"""Labeling runs: one stream of typed requests, whole messages, durable and visible while they run.

A message needs one answer for each label and one about coverage (what kind of message it is,
and whether any label captures it). Both kinds of requests go to one provider in one frame; a
message's answers are gathered into one row, which is stored whole or not at all.

Every finished task commits its rows at once, so a run that is ended in the middle, by a
failure or with its driver, keeps what its tasks have finished. Messages that fail are
stored as failures beside the rows; they hold back no others, and the next run asks them last.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.functions import prompts
from tutorlens.operators.sampling import KEY
from tutorlens.operators.verdicts import NO_RATIONALE, Provider, filtered_facets, offline, with_retries

#: Called with the counts of a run, again and again while it runs and once at its end: total, messages, verdicts, abstained, failed, error.
Progress = Callable[[dict], None]
ANSWERS = "chatlog_id bigint, message_index int, labels map<string,boolean>, rationales map<string,string>, evidence map<string,string>, no_label_fits boolean, coverage_note string, forms array<string>, concepts array<string>, move string, error string"
STORED = f"{ANSWERS}, schema_version string"
ANSWER_COLUMNS = (*KEY, "labels", "rationales", "evidence", "no_label_fits", "coverage_note", "forms", "concepts", "move", "error")
#: Messages of one call of a provider, and of one task; the most tasks of a run; failures one after the other at which a task ends.
MESSAGES_A_CALL, MESSAGES_A_TASK, MOST_TASKS, FAILURES_IN_A_ROW = 16, 256, 50_000, 5
#: Requests that are written together, whatever a call takes of them: making a frame costs far more than its rows.
REQUESTS_TOGETHER = 1024
#: Failed messages that an error names, and seconds between two looks at the counts.
NAMED, LOOK_SECONDS = 10, 0.5
LABEL, COVERAGE = "label", "coverage"


class LabelingError(RuntimeError):
    """Messages are left that the provider failed on; all others are stored."""


def requests(messages: pd.DataFrame, labels: pd.DataFrame, course: str = "", concepts: tuple[tuple[str, str], ...] = ()) -> pd.DataFrame:
    """One row for each message and label, and one about each message's coverage, messages in order.

    A row has all columns of its message and its label, `kind`, and `prompt`. The coverage row
    has all cues, so that a provider may look for what no label names.
    """
    defined = labels.assign(kind=LABEL)
    cues = ",".join(c for c in labels["cues"] if c) if "cues" in labels else ""
    extra = pd.DataFrame({"kind": [COVERAGE], "label": [None], "cues": [cues], "concept_names": [",".join(n for n, _ in concepts)]})
    rows = messages.merge(pd.concat([defined, extra], ignore_index=True), how="cross")
    shown = rows["shown"] if "shown" in rows else rows["text"].fillna("")
    by_label = {r["label"]: prompts.label_request(r, course) for r in labels.to_dict("records")}
    coverage = prompts.coverage_request(labels.to_dict("records"), course, concepts)
    return rows.assign(prompt=[f"{by_label.get(name, coverage) if kind == LABEL else coverage}\n\n{said}" for kind, name, said in zip(rows["kind"], rows["label"], shown, strict=True)])


def assembled(asked: pd.DataFrame, said: pd.DataFrame, n: int) -> list[dict]:
    """The answers of each message, without its key, from the answers to `requests`, which come in its order, n to a message.

    A label's row needs `applies` and may have a rationale and evidence; a coverage row may have
    no_label_fits, note, forms, concepts and move. A frame of another length is refused.
    """
    if len(said) != len(asked) or len(asked) % n:
        raise ValueError(f"{len(said)} answers to {len(asked)} requests")
    text = lambda x: x if isinstance(x, str) else ""
    listed = lambda x: [str(i) for i in x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else []
    column = lambda c: said[c].tolist() if c in said else [None] * len(said)
    names, applies = asked["label"].tolist(), said["applies"].tolist()
    why, spans = ([text(x) for x in column(c)] for c in ("rationale", "evidence"))
    none, note, forms, concepts, move = (column(c) for c in ("no_label_fits", "note", "forms", "concepts", "move"))
    out = []
    for i in range(0, len(names), n):
        last = i + n - 1
        own = range(i, last)
        out.append({
            "labels": {names[k]: bool(applies[k]) for k in own},
            "rationales": {names[k]: why[k] or NO_RATIONALE for k in own},
            "evidence": {names[k]: spans[k] for k in own if applies[k] and spans[k]},
            "no_label_fits": none[last] in (True, 1), "coverage_note": text(note[last]),
            "forms": listed(forms[last]), "concepts": listed(concepts[last]), "move": text(move[last]), "error": None,
        })
    return out


def _in_calls(
    frames: Iterator[pd.DataFrame], defined: pd.DataFrame, provider: Provider, attempts: int, base_seconds: float, each: int, course: str, concepts: tuple[tuple[str, str], ...], add: Callable[[str, int], None],
) -> Iterator[pd.DataFrame]:
    """A frame of ANSWERS for the messages of several calls, each of `each` messages; requests and answers are put into frames for all of them together."""
    n = len(defined) + 1
    together = max(1, REQUESTS_TOGETHER // (n * each)) * each
    in_a_row = 0
    for frame in frames:
        for i in range(0, len(frame), together):
            part = frame.iloc[i : i + together]
            asked, out = requests(part, defined, course, concepts), []

            def of(first: int, last: int) -> None:
                these = asked.iloc[first * n : last * n].reset_index(drop=True)
                rows = with_retries(lambda x: assembled(x, provider(x).reset_index(drop=True), n), these, attempts, base_seconds)
                out.extend(rows)
                add("messages", len(rows)), add("verdicts", len(rows) * len(defined)), add("abstained", sum(r["no_label_fits"] for r in rows))

            for first in range(0, len(part), each):
                last = min(first + each, len(part))
                try:
                    of(first, last)
                    in_a_row = 0
                    continue
                except Exception:  # the messages that can be finished are kept
                    pass
                for k in range(first, last):
                    try:
                        of(k, k + 1)
                        in_a_row = 0
                    except Exception as broken:
                        add("failed", 1)
                        in_a_row += 1
                        out.append({"error": str(broken) or type(broken).__name__})
                        if in_a_row >= FAILURES_IN_A_ROW:
                            break
                if in_a_row >= FAILURES_IN_A_ROW:
                    break
            # the answers are in the order of the messages
            keys = {c: part[c].tolist()[: len(out)] for c in KEY}
            yield pd.DataFrame(keys | {c: pd.Series([r.get(c) for r in out], dtype=object) for c in ANSWER_COLUMNS[len(KEY) :]})
            if in_a_row >= FAILURES_IN_A_ROW:
                return


def answered(
    messages: DataFrame, labels: DataFrame, provider: Provider = offline, attempts: int = 4, base_seconds: float = 2.0, each: int = MESSAGES_A_CALL,
    course: str = "", concepts: tuple[tuple[str, str], ...] = (), counts: dict | None = None,
) -> DataFrame:
    """A row of ANSWERS for each message; `error` is null unless the message failed, and then nothing else is there.

    Where a call fails after its retries, its messages are asked one by one, with retries; those
    that fail are told apart, and the task goes on, up to FAILURES_IN_A_ROW. Labels are
    definitions, a few dozen rows. `counts` are accumulators by name.
    """
    defined = labels.toPandas()

    def add(name: str, n: int) -> None:
        if counts is not None and n:
            counts[name].add(int(n))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_calls(frames, defined, provider, attempts, base_seconds, each, course, concepts, add)

    said = messages.mapInPandas(run, ANSWERS)
    known = filtered_facets(said, [n for n, _ in concepts])
    return known.select(*ANSWER_COLUMNS)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows below `path`, finished and failed ones; none where the folder is missing or empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(STORED).parquet(path) if there else spark.createDataFrame([], STORED)


def stored(spark: SparkSession, path: str, schema_version: str | None = None) -> DataFrame:
    """The finished messages below `path`, one row each, of one version or of all."""
    rows = ledger(spark, path).filter("error IS NULL").drop("error")
    return rows if schema_version is None else rows.filter(F.col("schema_version") == schema_version)


def failures(spark: SparkSession, path: str, schema_version: str) -> DataFrame:
    """(key, times, error) of the messages that failed under this version and are not finished yet."""
    rows = ledger(spark, path).filter(F.col("schema_version") == schema_version)
    # `error` is null in a finished row, and such a row is the last of its message
    out = rows.groupBy(*KEY).agg(F.count("error").alias("times"), F.max("error").alias("error"), F.count(F.when(F.col("error").isNull(), 1)).alias("finished"))
    return out.filter("finished = 0").drop("finished")


def as_long(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each message and label: key, label, applies, rationale, evidence, then `keep`."""
    long = rows.select(*KEY, "rationales", "evidence", *keep, F.explode("labels").alias("label", "applies"))
    return long.select(*KEY, "label", "applies", F.col("rationales")[F.col("label")].alias("rationale"), F.coalesce(F.col("evidence")[F.col("label")], F.lit("")).alias("evidence"), *keep)


class _Look:
    """Hands the counts of running tasks to `on_progress`; they come in as tasks end, and a task that runs twice counts twice."""

    def __init__(self, counts: dict, total: int, on_progress: Progress | None):
        self.counts, self.total, self.on_progress = counts, total, on_progress
        self.over, self.was = threading.Event(), {}
        self.thread = threading.Thread(target=self._run, daemon=True)

    def now(self) -> dict:
        return {k: a.value for k, a in self.counts.items()} | {"total": self.total, "error": None}

    def _run(self) -> None:
        while not self.over.wait(LOOK_SECONDS):
            if (now := self.now()) != self.was:
                self.was = now
                self.on_progress(now)

    def __enter__(self) -> _Look:
        if self.on_progress:
            self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        if self.on_progress:
            self.thread.join()


def label_messages(
    spark: SparkSession, messages: DataFrame, labels: DataFrame, path: str, schema_version: str, provider: Provider = offline, attempts: int = 4, base_seconds: float = 2.0,
    each: int = MESSAGES_A_CALL, on_progress: Progress | None = None, course: str = "", concepts: tuple[tuple[str, str], ...] = (), a_task: int = MESSAGES_A_TASK,
) -> DataFrame:
    """Asks for the messages that are not finished in this version below `path`, and returns the version's finished rows.

    A task's rows are there as soon as the task has ended, whatever becomes of the run; a task has
    `a_task` messages at most (more beyond MOST_TASKS tasks), and that is what a run can lose.
    Messages that failed before are asked behind all others of their task. If any are left without an
    answer, LabelingError says how many and names some; a further call asks only for those. Rows of
    other versions do not count. One run at a time may write below a path.
    """
    known = messages.dropDuplicates(list(KEY))
    had = stored(spark, path, schema_version).select(*KEY)
    failed = failures(spark, path, schema_version).select(*KEY, "times")
    todo = known.join(had, list(KEY), "left_anti").join(failed, list(KEY), "left").persist(StorageLevel.DISK_ONLY)
    try:
        total = todo.count()
        context = spark.sparkContext
        counts = {k: context.accumulator(0) for k in ("messages", "verdicts", "abstained", "failed")}
        if total:
            n = min(MOST_TASKS, -(-total // a_task))
            dealt = todo.repartition(n, *KEY).sortWithinPartitions(F.coalesce("times", F.lit(0)), F.xxhash64(*KEY)).drop("times")
            new = answered(dealt, labels, provider, attempts, base_seconds, each, course, concepts, counts).withColumn("schema_version", F.lit(schema_version))
            with _Look(counts, total, on_progress) as look:
                # with the second version of Hadoop's commit a task moves its file into the table when it ends
                new.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(path)
        else:
            look = _Look(counts, 0, None)
        rows = stored(spark, path, schema_version)
        left = todo.join(rows.select(*KEY), list(KEY), "left_anti").select(*KEY)
        missing = left.count() if total else 0
        why = ""
        if missing:
            said = left.join(failures(spark, path, schema_version), list(KEY)).orderBy(*KEY).limit(NAMED).collect()
            why = "; ".join(f"{r['chatlog_id']}/{r['message_index']}: {r['error']}" for r in said)
        if on_progress:
            on_progress(look.now() | {"error": why or None})
        if missing:
            raise LabelingError(f"{missing} messages have no answer: {why}")
        return rows
    finally:
        todo.unpersist()


def with_facts(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Finished rows with what is known of their messages, as a snapshot keeps them; a fact that is not known stays null."""
    facts = {"latency_seconds": "double", "latency_bucket": "string", "mode": "string", "defected": "boolean", "question_ref": "string", "pre_pattern": "string", "seq_granularity": "string", "attempted": "boolean", "error_verified": "boolean"}
    own = messages.select(*KEY, *[(F.col(c) if c in messages.columns else F.lit(None)).cast(t).alias(c) for c, t in facts.items()])
    return rows.drop("schema_version").join(own.dropDuplicates(list(KEY)), list(KEY), "left")


def shown(messages: DataFrame, before_minutes: int) -> Column:
    """What a prompt says of a message: the turns before it, the wait, the runs, the mode, its text and the reply, where each is known."""
    return prompts.message_block(messages.columns, before_minutes)


def compacted(spark: SparkSession, path: str, target: str, rows_a_file: int = 100_000) -> str:
    """Writes the finished rows and the open failures below `path` to the new folder `target`, in few files, and returns it.

    Tasks leave a small file each; a run may go on below `target`, and `path` is left as it is.
    """
    rows = ledger(spark, path)
    finished = rows.filter("error IS NULL").select(*KEY, "schema_version").distinct()
    left = rows.filter("error IS NOT NULL").join(finished, [*KEY, "schema_version"], "left_anti").select(rows.columns)
    every = rows.filter("error IS NULL").unionByName(left)
    every.repartition(max(1, -(-every.count() // rows_a_file))).write.mode("errorifexists").parquet(target)
    return target
