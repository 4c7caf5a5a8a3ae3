"""Text functions: question references, shingles, lint, renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a word boundary that treats all letters and digits alike, in any script; each pattern begins with what it looks for, so that few places are tried
_RIGHT = r"(?![\p{L}\p{N}_])"
_Q = r"[qQ](?<![\p{L}\p{N}_][qQ])"
#: Forms of a reference, tried in this order: q1_10, question 1.2, 1.5.2.
REFERENCES = (
    rf"{_Q}([0-9]+(?:[._][0-9]+)*){_RIGHT}",
    rf"{_Q}[uU][eE][sS][tT][iI][oO][nN]\s+([0-9]+(?:\.[0-9]+)*){_RIGHT}",
    rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_])([0-9]+\.[0-9]+(?:\.[0-9]+)*){_RIGHT}",
)


def question_ref(text: Column) -> Column:
    """The first reference to a question as a grader id (q3_2); '' where there is none or the text is null."""
    # each text is searched once for each form; the first form with a match counts
    found = F.filter(F.array(*[F.regexp_extract(text, p, 1) for p in REFERENCES]), lambda x: x != "")
    ref = F.concat(F.lit("q"), F.translate(F.get(found, F.lit(0)), ".", "_"))
    return F.when(text.rlike("[0-9]"), F.coalesce(ref, F.lit(""))).otherwise("")


def lint_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def shingles(words: Column, width: int) -> Column:
    """Every run of `width` words, joined by spaces; none of a shorter text."""
    last = F.size(words) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of every run of `width` words; none of a shorter text."""
    last = F.size(words) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def latency_bucket(seconds: Column, opening: Column, rapid: int = 120, working: int = 1800, delayed: int = 21600) -> Column:
    """Left-closed classes of the wait since the last tutor turn."""
    return (
        F.when(opening, "conversation-opening")
        .when(seconds.isNull(), "unknown")
        .when(seconds < rapid, "rapid")
        .when(seconds < working, "working")
        .when(seconds < delayed, "delayed")
        .otherwise("returned")
    )


#: The sentences of the renderings below are fixed values: classifiers are asked with them.
def _whole(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint").cast("string")


def render_latency(seconds: Column, bucket: Column) -> Column:
    unit = (
        F.when(seconds < 120, F.concat(_whole(seconds), F.lit(" seconds")))
        .when(seconds < 7200, F.concat(_whole(seconds / 60), F.lit(" minutes")))
        .when(seconds < 172800, F.concat(_whole(seconds / 3600), F.lit(" hours")))
        .otherwise(F.concat(_whole(seconds / 86400), F.lit(" days")))
    )
    return F.when(bucket == "conversation-opening", "(conversation opening)").when(seconds.isNull(), "(unknown)").otherwise(F.concat(unit, F.lit(" ("), bucket, F.lit(")")))


def render_sequence(pre: Column, granularity: Column, minutes: Column, success: Column, grader: Column, traceback: Column, before_minutes: int = 45) -> Column:
    grain = F.when(granularity == "question", "question-level").otherwise("notebook-level")
    none = F.concat(F.lit(f"No autograder activity in the {before_minutes} min before this message ("), grain, F.lit(")"))
    verdict = F.when(F.coalesce(success, F.lit(False)), "PASSED").otherwise("FAILED")
    last = F.concat(F.lit("last run "), F.coalesce(F.concat(_whole(minutes), F.lit("m")), F.lit("?")), F.lit(" before this message: "), verdict, F.lit(" ("), F.coalesce(F.nullif(grader, F.lit("")), F.lit("unknown check")), F.lit(", "), grain, F.lit(")"))
    said = F.when(pre == "ask-first", none).otherwise(last)
    after = F.when(F.coalesce(traceback, F.lit(False)), "; notebook snapshot at conversation start showed a traceback").otherwise("")
    return F.when(F.coalesce(pre, F.lit("")) == "", "No autograder data for this conversation.").otherwise(F.concat(said, after))


def render_mode(mode: Column) -> Column:
    return (
        F.when(mode == "chatgpt", "plain-ChatGPT mode — the student toggled the tutor persona off for this message")
        .when(mode == "tutor", "tutor mode")
        .otherwise("unknown (older log)")
    )


def render_window(context: Column) -> Column:
    """The turns before a message, an array of structs with role and text, as lines."""
    lines = F.array_join(F.transform(context, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return F.when(F.size(context) > 0, lines).otherwise("(conversation start)")


#: Parts of a stratum in words.
STRATUM_WORDS = {"short": "short conversation", "mid": "medium conversation", "long": "long conversation", "early": "early turn", "late": "late turn"}


def plain_stratum(stratum: Column) -> Column:
    """The stratum in words: the part before the first slash and all that follows are looked up apart, and what is not known stays as it is."""
    named = F.create_map(*[F.lit(x) for pair in STRATUM_WORDS.items() for x in pair])
    head, rest = F.substring_index(stratum, "/", 1), F.regexp_replace(stratum, r"^[^/]*/?", "")
    return F.concat(F.coalesce(named[head], head), F.lit(" · "), F.coalesce(named[rest], rest))
