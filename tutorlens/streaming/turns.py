"""Turns of conversations as their events arrive: assembly, waits and switches of mode with state for each conversation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tutorlens.params import Params
from tutorlens.sources.events import TALK

TURNS = "conv_id string, chatlog_id bigint, turn_index int, role string, text string, student_index int, us bigint, mode string, event_id bigint, latency_seconds double, latency_bucket string, defected boolean"
#: What is kept of a conversation: counts, the first event, the last tutor turn and the last known mode, and events that wait for the watermark, as JSON.
STATE = "n_turns int, n_student int, chatlog_id bigint, told boolean, told_us bigint, mode string, waiting string"


def bucket(seconds: float | None, opening: bool, params: Params) -> str:
    """The class of a wait, as `functions.text.latency_bucket` has it."""
    if opening:
        return "conversation-opening"
    if seconds is None:
        return "unknown"
    return next((name for name, most in (("rapid", params.rapid_seconds), ("working", params.working_seconds), ("delayed", params.delayed_seconds)) if seconds < most), "returned")


def turns_as_they_arrive(log: DataFrame, delay: str = "10 minutes", forget_days: float = 7, params: Params = Params()) -> DataFrame:
    """The turns of a streaming log, with `latency_seconds`, `latency_bucket` and `defected`, each as soon as the watermark has passed it.

    Events may come in any order within `delay` of the latest time; they wait in the state of their
    conversation until no earlier one can come, and are then taken in the order of event_id, which
    is that of time. So the rows are those of the batch form. Events that come later than that are
    dropped by Spark and counted in the query's progress. A conversation that is silent for
    `forget_days` is forgotten: it would begin anew. Events without a time or a conversation are left out.
    """
    talk = log.filter(F.col("event_type").isin(*TALK) & F.col("conv_id").isNotNull() & F.col("us").isNotNull())
    timed = talk.select("conv_id", "event_id", "us", "event_type", "question", "response", "mode", F.timestamp_micros("us").alias("at")).withWatermark("at", delay)
    keep_ms = int(forget_days * 86_400_000)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n_turns, n_student, chatlog, told, told_us, mode, waiting = state.get if state.exists else (0, 0, None, False, None, "", "[]")
        held = json.loads(waiting)
        if not state.hasTimedOut:
            for frame in frames:
                for e in frame.itertuples(index=False):
                    said = e.question if e.event_type == "tutor_query" else e.response
                    held.append([int(e.event_id), int(e.us), e.event_type == "tutor_query", said if isinstance(said, str) else "", e.mode if isinstance(e.mode, str) else ""])
        now = state.getCurrentWatermarkMs()
        ready = sorted(e for e in held if e[1] // 1000 < now)
        left = [e for e in held if e[1] // 1000 >= now]
        out = []
        for event_id, us, asked, said, own in ready:
            chatlog = event_id if chatlog is None else min(chatlog, event_id)
            if not said or not (asked or n_turns):
                continue
            seconds = (us - told_us) / 1e6 if told and told_us is not None else None
            role = "student" if asked else "tutor"
            defected = asked and own == "chatgpt" and mode == "tutor"
            out.append((key[0], chatlog, n_turns, role, said, n_student if asked else None, us, own if asked else "", event_id, seconds, bucket(seconds, not told, params), defected))
            n_turns += 1
            if asked:
                n_student += 1
                mode = own or mode
            else:
                told, told_us = True, us
        if state.hasTimedOut and not left and not ready:
            state.remove()
        else:
            state.update((n_turns, n_student, chatlog, told, told_us, mode, json.dumps(left)))
            state.setTimeoutTimestamp(max(now + 1, min(e[1] // 1000 for e in left) + 1) if left else now + keep_ms)
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in TURNS.split(", ")])
            yield frame.astype({"student_index": "Int32", "latency_seconds": "Float64", "turn_index": "int32"})

    return timed.groupBy("conv_id").applyInPandasWithState(advance, TURNS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
