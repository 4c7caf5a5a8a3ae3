"""License scans: license texts written as template markup, compiled into token automata.

A template is the wording of a license with marked regions:

    <<beginOptional>> ... <<endOptional>>   wording that may be left out as a whole
    <<var;least=0;most=40>>                 a place for `least` to `most` words of any kind

Everything else is mandatory, and must be there word for word. A template is compiled into a
nondeterministic automaton over words; sets of its states are made into a deterministic one
as texts need them, so a text is read once, one table look-up a word. Case, punctuation and
line breaks do not matter, as words are what stands between them.

A match begins where a literal word of the template does and is as long as possible; a match
within a longer one of the same template is not reported, so a phrase without regions is
found at every place where its words stand consecutively.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.tables import added, table


class Template(NamedTuple):
    name: str
    label: str
    markup: str


#: The phrases whose places are counted, in the contract's order, and their labels.
BASE = (
    Template("mit-phrase", "mit", "under the MIT License"),
    Template("apache-2-phrase", "apache-2", "Apache License, Version 2"),
    Template("cc-by-nc-phrase", "cc-by-nc", "CC BY-NC"),
)
#: The wording of licenses and notices.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;least=1;most=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;least=1;most=16>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
TEMPLATES = BASE + (
    Template("mit-text", "mit", """<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;least=1;most=40>><<endOptional>> Permission is hereby granted, free of charge, to any person
obtaining a copy of <<var;least=1;most=8>> (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. """ + WARRANTY),
    Template("isc-text", "isc", """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;least=1;most=40>><<endOptional>> Permission to use, copy, modify, and <<beginOptional>>/or<<endOptional>> distribute this
software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("bsd-2-text", "bsd-2-clause", BSD_HEAD + " " + BSD_TAIL),
    Template("bsd-3-text", "bsd-3-clause", BSD_HEAD + """ <<beginOptional>>3.<<endOptional>> Neither the name of <<var;least=1;most=12>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """ + BSD_TAIL),
    Template("apache-2-notice", "apache-2", """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use <<var;least=1;most=4>> except in compliance with the License.<<endOptional>>"""),
    Template("gpl-3-notice", "gpl-3", """<<beginOptional>>This work is<<endOptional>> licensed under the GNU General Public License, <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3"""),
    Template("gpl-later-notice", "gpl-3-or-later", """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    Template("mit-notice", "mit", """<<beginOptional>>This <<var;least=1;most=3>> is<<endOptional>> released under <<beginOptional>>the terms of<<endOptional>> the MIT License"""),
    Template("cc-by-nc-notice", "cc-by-nc-4", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0"""),
    Template("spdx-mit", "mit", "SPDX-License-Identifier: MIT"),
    Template("spdx-apache-2", "apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("spdx-bsd-3", "bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
#: Mandatory words that give a score of one half.
HALF = 4
#: States of the deterministic automaton that are kept; beyond them it is begun anew.
STATES = 200_000
_MARK = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
SPANS = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str) -> list[bytes]:
    """The words of a text: runs of digits, a-z (A-Z folded) and characters from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def parsed(markup: str) -> list:
    """The template as a list of words, ("var", least, most) and ("optional", [...]); markup that is not well formed is refused."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += words_of(markup[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            body = stack.pop()
            stack[-1].append(("optional", body))
        else:
            given = dict(x.split("=", 1) for x in m[2].split(";") if "=" in x)
            least, most = int(given.get("least", 0)), int(given.get("most", 20))
            if not 0 <= least <= most:
                raise ValueError(f"a region of {least} to {most} words")
            stack[-1].append(("var", least, most))
    if "<<" in markup[at:] or len(stack) != 1:
        raise ValueError("markup that is not closed")
    out = stack[0] + words_of(markup[at:])
    if not mandatory(out):
        raise ValueError("a template needs mandatory words")
    if _open(out, 1) or _open(out, -1):
        raise ValueError("a template begins and ends with wording, not with a replaceable region")
    return out


def _open(parts: list, step: int) -> bool:
    """Whether a replaceable region can be the first thing of the parts (step 1), or the last (step -1)."""
    for p in parts[::step]:
        if isinstance(p, bytes):
            return False
        if p[0] == "var" or _open(p[1], step):
            return True
    return False


def mandatory(parts: list) -> int:
    """How many words a text must have word for word."""
    return sum(isinstance(p, bytes) for p in parts)


def hint(parts: list) -> bytes:
    """The longest run of mandatory words: every text that is accepted has it."""
    runs, now = [], []
    for p in [*parts, None]:
        if isinstance(p, bytes):
            now.append(p)
        else:
            runs.append(b" ".join(now))
            now = []
    return max(runs, key=len)


class Automaton:
    """All templates as one automaton over words."""

    def __init__(self, templates: tuple[Template, ...]):
        self.literal: list[tuple[bytes, int] | None] = []  # a state's word and the state behind it
        self.any: list[int | None] = []  # the state behind any word
        self.empty: list[list[int]] = []  # states reached without a word
        self.ends: dict[int, int] = {}
        self.starts, self.hints = [], []
        for i, t in enumerate(templates):
            parts = parsed(t.markup)
            first = self._state()
            self.ends[self._compile(parts, first)] = i
            self.starts.append(first)
            self.hints.append(b" " + hint(parts) + b" ")
        self.closed = [self._closure({s}) for s in range(len(self.literal))]
        self.next: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.accepts: dict[frozenset, tuple[int, ...]] = {}
        self.vocabulary = {x[0] for x in self.literal if x}

    def _state(self) -> int:
        self.literal.append(None), self.any.append(None), self.empty.append([])
        return len(self.literal) - 1

    def _compile(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, bytes):
                new = self._state()
                self.literal[at] = (p, new)
            elif p[0] == "optional":
                inner, new = self._state(), self._state()
                self.empty[at] += [inner, new]
                self.empty[self._compile(p[1], inner)].append(new)
            else:
                new = self._state()
                for k in range(p[2]):
                    if k >= p[1]:
                        self.empty[at].append(new)
                    after = self._state()
                    self.any[at] = after
                    at = after
                self.empty[at].append(new)
            at = new
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def begin(self, chosen: list[int]) -> dict[bytes, frozenset]:
        """For each word that can begin one of the chosen templates the states behind it."""
        out: dict[bytes, set] = {}
        for i in chosen:
            for s in self.closed[self.starts[i]]:
                if self.literal[s]:
                    word, then = self.literal[s]
                    out.setdefault(word, set()).update(self.closed[then])
        return {w: frozenset(s) for w, s in out.items()}

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.vocabulary else None)
        if (found := self.next.get(key)) is None:
            out: set[int] = set()
            for s in states:
                if self.literal[s] and self.literal[s][0] == word:
                    out |= self.closed[self.literal[s][1]]
                if self.any[s] is not None:
                    out |= self.closed[self.any[s]]
            if len(self.next) > STATES:
                self.next.clear()
            found = self.next[key] = frozenset(out)
        return found

    def accepted(self, states: frozenset) -> tuple[int, ...]:
        if (found := self.accepts.get(states)) is None:
            if len(self.accepts) > STATES:
                self.accepts.clear()
            found = self.accepts[states] = tuple(self.ends[s] for s in states if s in self.ends)
        return found

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of all matches, by start, then template; ends are exclusive."""
        joined = b" " + b" ".join(words) + b" "
        chosen = [i for i, h in enumerate(self.hints) if h in joined]
        if not chosen:
            return []
        begin, last, out = self.begin(chosen), {}, []
        for start, word in enumerate(words):
            if (states := begin.get(word)) is None:
                continue
            found: dict[int, int] = {}
            at = start + 1
            while states:
                for t in self.accepted(states):
                    found[t] = at
                if at == len(words):
                    break
                states = self.step(states, words[at])
                at += 1
            for t in sorted(found):
                if found[t] > last.get(t, -1):  # else it lies in a match that begins before
                    last[t] = found[t]
                    out.append((t, start, found[t]))
        return out


@functools.lru_cache(maxsize=4)
def _automaton(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


def license_matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """`docs` with two more columns: n_words, and matches, an array of (template, start, end) in words from 0.

    Every text is read whole, a null one as empty; nothing is shuffled, so rows are kept one by
    one, repeated ones and null ids included, and an empty table stays empty. A task holds a
    slice of about 4 MB of text, or one longer text. See `added` for columns of these names.
    """
    names = added(docs, "n_words", "matches")
    Automaton(templates)  # markup that is not well formed fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tutorlens.llm.words import slices

        machine = _automaton(templates)
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                n, found = np.zeros(batch.num_rows, np.int64), []
                for i, said in enumerate(batch.column(text)):
                    words = words_of(said.as_py() or "")
                    n[i] = len(words)
                    found.append([{"template": t, "start": a, "end": b} for t, a, b in machine.matches(words)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(found, SPANS)], [*batch.schema.names, *names])

    had = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{had}{', ' if had else ''}`{names[0]}` bigint, `{names[1]}` array<struct<template:int,start:int,end:int>>")


def weights(templates: tuple[Template, ...] = TEMPLATES) -> list[float]:
    """What a match of each template says, from 0 to 1: the more mandatory words, the more."""
    return [m / (m + HALF) for m in (mandatory(parsed(t.markup)) for t in templates)]


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; `score` is the weight of the match with most mandatory words, 0 without any."""
    found = license_matches(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("matches", lambda m: m["template"] < len(BASE))
    labels, weight = F.array(*[F.lit(t.label) for t in TEMPLATES]), F.array(*[F.lit(w) for w in weights()])
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: F.get(labels, m["template"])))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).cast("bigint").alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: F.get(weight, m["template"]))), F.lit(0.0)).alias("score"),
    )


def pattern(parts: list) -> str:
    """The template as a regular expression over words that each have one space before them."""
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += " " + p.decode()
        elif p[0] == "optional":
            out += f"(?:{pattern(p[1])})?"
        else:
            out += f"(?: [^ ]+){{{p[1]},{p[2]}}}"
    return out


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB's SQL for the query: phrases are found in lists of words, templates as regular expressions."""
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    rows = [(i, t.label, parsed(t.markup)) for i, t in enumerate(templates)]
    listed = ", ".join(f"({i}, '{label}', {mandatory(p)} / ({mandatory(p)} + {HALF}), '{hint(p).decode()}', '{pattern(p)} ')" for i, label, p in rows)
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w.decode()) for w in p)}])" for i, label, p in rows if i < len(BASE))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM (SELECT doc_id, {words} AS w FROM documents)),
b AS (SELECT doc_id, label, unnest(list_filter(generate_series(0, len(w) - len(p)), lambda i: w[i + 1:i + len(p)] = p)) AS place
  FROM d, (VALUES {phrases}) q(label, p) WHERE contains(j, ' ' || array_to_string(p, ' ') || ' ')),
s AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
m AS (SELECT doc_id, label, weight FROM d, (VALUES {listed}) t(i, label, weight, hint, pattern) WHERE contains(j, ' ' || hint || ' ') AND regexp_matches(j, pattern)),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
  coalesce(s.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN a USING (doc_id)
"""
