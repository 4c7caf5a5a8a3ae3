"""Label verdicts from an injected provider: fan out, ask in batches, assemble.

A provider is a function of a pandas frame of (message, label) rows that returns verdicts for
them. The one here is deterministic and offline; another may call a service.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlens.operators.sampling import KEY
from tutorlens.params import FORMS, MOVES

Provider = Callable[[pd.DataFrame], pd.DataFrame]
VERDICT = "chatlog_id bigint, message_index int, label string, applies boolean, rationale string, evidence string"
NO_RATIONALE = "(no rationale returned)"


@dataclass(frozen=True)
class Sampling:
    """How verdicts are generated where they are drawn several times; a labeling run has no temperature.

    `runs` and `temperature` reach a provider as columns of the same names.
    """

    runs: int = 5
    temperature: float = 0.7


def offline(rows: pd.DataFrame) -> pd.DataFrame:
    """Applies a label to a message that holds one of the label's cue words (a string, separated by commas).

    Of a message's coverage it says that no label fits where no cue of any label is held, tells
    nudges of one or two words from pasted errors and questions, and takes a conversation's
    opening for a new topic, a rapid message for a response, and any other for the student's own thread.
    """
    text = [t.lower() if isinstance(t, str) else "" for t in rows["text"]]
    split = {c: [x for x in c.split(",") if x] for c in set(rows["cues"])}
    hit = [next((c for c in split[cues] if c in t), "") for t, cues in zip(text, rows["cues"], strict=True)]
    out = {"applies": [bool(h) for h in hit], "rationale": [f"mentions {h}" if h else "" for h in hit], "evidence": hit}
    if "kind" not in rows:
        return pd.DataFrame(out)
    form = ["nudge" if len(t.split()) < 3 else "pasted-error" if "traceback" in t or "failing" in t else "authored-question" for t in text]
    waits = rows["latency_bucket"] if "latency_bucket" in rows else [""] * len(rows)
    move = [{"conversation-opening": MOVES[1], "rapid": MOVES[0]}.get(w, MOVES[2]) for w in waits]
    names = [own if isinstance(own, str) else "" for own in rows["concept_names"]]
    # one frame from lists: a call has few rows, and each column of pandas costs more than all of them
    return pd.DataFrame(out | {
        "no_label_fits": [not h for h in hit], "note": ["" if h else f"none of the cues in {len(t)} characters" for h, t in zip(hit, text, strict=True)], "forms": [[f] for f in form], "move": move,
        "concepts": [[n for n in own.split(",") if n and n.lower() in t] for own, t in zip(names, text, strict=True)],
    })


def with_retries(ask: Provider, rows: pd.DataFrame, attempts: int = 4, base_seconds: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> pd.DataFrame:
    """The provider's answer, asked again after growing waits; the last failure is raised."""
    for i in range(attempts):
        try:
            return ask(rows)
        except Exception:
            if i == attempts - 1:
                raise
            sleep(base_seconds * 2**i)
    raise ValueError("attempts must be positive")


def fan_out(messages: DataFrame, labels: DataFrame) -> DataFrame:
    return messages.crossJoin(F.broadcast(labels))


def _said(frame: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
    said = said.reset_index(drop=True)
    out = frame[[*KEY, "label"]].reset_index(drop=True)
    out["applies"] = said["applies"].astype(bool)
    out["rationale"] = [r or NO_RATIONALE for r in said["rationale"]]
    out["evidence"] = [e if a else "" for e, a in zip(said["evidence"], said["applies"], strict=True)]
    return out


def ask(pairs: DataFrame, provider: Provider = offline, attempts: int = 4, base_seconds: float = 2.0) -> DataFrame:
    """Verdicts for (message, label) rows; an empty rationale is said to be missing, evidence is kept where the label applies.

    The provider's last failure fails the job; `labeling.label_messages` keeps what is finished.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield _said(frame, with_retries(provider, frame, attempts, base_seconds))

    return pairs.mapInPandas(run, VERDICT)


def votes(pairs: DataFrame, provider: Provider, sampling: Sampling = Sampling(), attempts: int = 4, base_seconds: float = 2.0) -> DataFrame:
    """(run, chatlog_id, message_index, label, applies): every pair asked `sampling.runs` times at its temperature."""
    every = pairs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(sampling.runs - 1)))).withColumn("temperature", F.lit(sampling.temperature))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                out = _said(frame, with_retries(provider, frame, attempts, base_seconds))
                yield out.assign(run=frame["run"].to_numpy())[["run", *KEY, "label", "applies"]]

    return every.mapInPandas(run, "run int, chatlog_id bigint, message_index int, label string, applies boolean")


def as_maps(long: DataFrame) -> DataFrame:
    """One row per message with maps label -> applies, rationale, evidence, as snapshots keep them."""
    one = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", c)))).alias
    return long.groupBy(*KEY).agg(one("applies")("labels"), one("rationale")("rationales"), one("evidence")("evidence"))


def as_long(maps: DataFrame) -> DataFrame:
    return maps.select(*KEY, F.explode("labels").alias("label", "applies"))


def applied(labels: Column) -> Column:
    """The names of the labels that apply, from a map."""
    return F.map_keys(F.map_filter(labels, lambda _, v: v))


def filtered_facets(facets: DataFrame, concepts: list[str]) -> DataFrame:
    """Facets cut to their taxonomies: known forms in order, a known move or '', known concepts, a note of abstentions only."""
    within = lambda c, names: F.filter(c, lambda x: x.isin(*names)) if names else F.array().cast("array<string>")
    return facets.withColumns({
        "forms": within("forms", FORMS), "concepts": within("concepts", concepts),
        "move": F.when(F.col("move").isin(*MOVES), F.col("move")).otherwise(""),
        "coverage_note": F.when(F.col("no_label_fits"), F.col("coverage_note")).otherwise(""),
    })


def without_context(messages: DataFrame) -> DataFrame:
    """The messages as an ablation sees them: no turns before or after, and no wait, where that is known."""
    out = messages.withColumn("context", F.filter("context", lambda _: F.lit(False))).withColumn("context_after", F.lit(None).cast("string"))
    blank = {"latency_seconds": F.lit(None).cast("double"), "latency_bucket": F.lit("unknown")}
    return out.withColumns({c: v for c, v in blank.items() if c in messages.columns})


def without_sequence(messages: DataFrame) -> DataFrame:
    """The messages without what is known of runs, mode and traceback."""
    blank = {"pre_pattern": "", "last_run_grader": "", "mode": "", "seq_granularity": ""}
    return messages.withColumns({k: F.lit(v) for k, v in blank.items()} | {"last_run_minutes": F.lit(None).cast("double"), "last_run_success": F.lit(None).cast("boolean"), "snapshot_traceback": F.lit(False)})
