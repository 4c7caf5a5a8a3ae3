"""Thresholds, windows and caps, in one hashed value."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    """Fixed values that results depend on. Times are minutes unless named otherwise."""

    before_minutes: int = 45
    outcome_minutes: int = 20
    window_turns: int = 6
    rapid_seconds: int = 120
    working_seconds: int = 1800
    delayed_seconds: int = 21600
    overlap_jaccard: float = 0.4
    kappa_floor: float = 0.2
    alt_test_epsilon: float = 0.1
    lint_words: int = 8
    least_weeks: int = 3
    seed: int = 7

    @property
    def version(self) -> str:
        return content_hash(asdict(self))


def content_hash(value: object) -> str:
    """The first 12 hex digits of the SHA-256 of the value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:12]


#: The taxonomies that free-form facets are filtered by.
FORMS = ("authored-question", "pasted-assignment", "pasted-error", "code-share", "nudge", "answer-reply", "other")
MOVES = ("responds-to-tutor", "initiates-new-topic", "continues-own-thread")
#: Words that a description and a criterion may have, and the columns of the split by mode.
DESCRIPTION_WORDS, CRITERION_WORDS = 20, 25
MODES = ("tutor", "chatgpt", "unknown")
