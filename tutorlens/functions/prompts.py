"""Blocks of prompts, rendered from tables of labels, concepts and layers: one row, one column each.

The tables hold definitions, a few dozen rows; lines keep their order by `ord`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlens.functions import text as T
from tutorlens.params import FORMS, MOVES

#: What stands for an empty list of concepts, and the parts of lines.
NONE, APPLIES = "(none)", " | applies: "
#: The lines of a course's context, in order, after the head line.
CONTEXT = (("Tooling: ", "tooling"), ("Pasted material: ", "paste_conventions"), ("Assignment references: ", "reference_conventions"), ("Message shape: ", "message_shape_notes"))


def _lines(rows: DataFrame, line: Column, order: list[str], name: str, empty: str = "") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.agg(F.coalesce(F.nullif(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("")), F.lit(empty)).alias(name))


def _named() -> Column:
    return F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("description", F.lit("")))


def labels_block(labels: DataFrame) -> DataFrame:
    """(labels_block): a line for each label (ord, name, description)."""
    return _lines(labels, _named(), ["ord"], "labels_block")


def concepts_block(concepts: DataFrame) -> DataFrame:
    """(concepts_block): a line for each concept that is not promoted to a label."""
    return _lines(concepts.filter(~F.col("promoted")), _named(), ["ord"], "concepts_block", NONE)


def covered_block(concepts: DataFrame, *layers: DataFrame) -> DataFrame:
    """(covered_block): what the standing layers cover: promoted concepts first, then each layer's labels; '' without any."""
    every = concepts.filter("promoted").select(F.lit(0).alias("layer"), "ord", "name", "description", "positive_criteria")
    for i, layer in enumerate(layers, 1):
        every = every.unionByName(layer.select(F.lit(i).alias("layer"), "ord", "name", "description", "positive_criteria"))
    return _lines(every, F.concat(_named(), F.lit(APPLIES), F.coalesce("positive_criteria", F.lit(""))), ["layer", "ord"], "covered_block")


def course_context(course: DataFrame, concepts: DataFrame) -> DataFrame:
    """(course_context): the course's description, a line for each kind of note, and the names of its concepts."""
    head = F.concat("course_name", F.lit(": "), "domain_description")
    names = concepts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    last = F.concat(F.lit("Course concepts: "), F.coalesce(F.nullif("names", F.lit("")), F.lit(NONE)))
    return course.crossJoin(F.broadcast(names)).select(F.concat_ws("\n", head, *[F.concat(F.lit(said), F.coalesce(c, F.lit(""))) for said, c in CONTEXT], last).alias("course_context"))


#: What a judge is told besides the definitions.
GUIDE = """Tell the student's own words from what was pasted: pasted text alone shows no feeling, only what it is used for.
Read a very short message in the light of the turns right before it. Judge what the student does in this message."""


def label_request(label: dict, course: str = "") -> str:
    """The request for one label: the course, the guide, and the label's definition."""
    about = lambda c: str(label.get(c) or "")
    lines = [f"Does one label fit one message of a student to a tutor?\nCourse: {course or NONE}\n{GUIDE}", f"Label {about('label')}: {about('description')}"]
    lines += [f"{said}{about(c)}" for said, c in (("It applies when: ", "positive_criteria"), ("It does not apply when: ", "negative_criteria")) if about(c)]
    return "\n".join([*lines, "Answer: applies, a rationale of one sentence, and the shortest literal span that shows it."])


def coverage_request(labels: list[dict], course: str = "", concepts: tuple[tuple[str, str], ...] = ()) -> str:
    """The request about coverage: all labels, the known forms and moves, and the course's concepts that are not labels."""
    listed = [f"- {x.get('label')}: {x.get('description') or ''}" for x in labels]
    taught = ["Concepts: ", *[f"- {n}: {d}" for n, d in concepts]] if concepts else []
    return "\n".join([
        f"What kind of message is this, and does any label capture it?\nCourse: {course or NONE}\n{GUIDE}", "Labels:", *(listed or [NONE]), *taught,
        f"Forms, all that fit: {', '.join(FORMS)}", f"Move, one of: {', '.join(MOVES)}",
        "Answer: forms, move, concepts by name, whether no label fits what the student does, and if so a note of one sentence that names no label.",
    ])


def message_block(columns: list[str], before_minutes: int) -> Column:
    """The part of a request about the message, from the columns that are there."""
    has, c = set(columns), F.col
    none = F.lit("(unknown)")
    window = T.render_window(c("context")) if "context" in has else none
    wait = T.render_latency(c("latency_seconds"), c("latency_bucket")) if {"latency_seconds", "latency_bucket"} <= has else none
    facts = ("pre_pattern", "seq_granularity", "last_run_minutes", "last_run_success", "last_run_grader", "snapshot_traceback")
    runs = T.render_sequence(*[c(x) for x in facts], before_minutes) if set(facts) <= has else F.lit("No autograder data for this conversation.")
    mode = T.render_mode(c("mode")) if "mode" in has else T.render_mode(F.lit(""))
    reply = F.coalesce("context_after", F.lit("")) if "context_after" in has else F.lit("")
    parts = (("Turns before:\n", window), ("Wait since the tutor's last turn: ", wait), ("Test runs: ", runs), ("Mode: ", mode), ("Message:\n", F.coalesce("text", F.lit(""))), ("Reply:\n", reply))
    return F.concat_ws("\n", *[F.concat(F.lit(name), said) for name, said in parts])
