"""Postings of hashed windows, shuffled as packed chunks of numpy arrays.

A posting says that a hash occurs in a document at a place. Tasks gather a block of postings,
deal them by hash into parts, and send one packed row for each part; a part's rows meet in one
task, are sorted there, and what is found goes back in packed rows dealt by document.

A part has the postings of about 4 MB of text, so there are more of them the more text there is.
A block is cut into MOST_PARTS rows at most, 128 postings each: beyond that number, parts come in
coarse ones of `fine` parts each. Blocks are dealt to the coarse parts, what comes together there is
gathered to blocks again, and these are dealt to the fine parts by a second shuffle. So a posting
takes six to ten bytes in a shuffle at any size, and is shuffled once more from 32 GB of text on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlens.llm.words import mix

#: A packed row: runs of postings of one document each. `low` are hash bits below those of the part; `sub` the fine parts, where `part` is a coarse one.
CHUNK = "kind tinyint, part int, sub binary, docs binary, runs binary, low binary, pos binary, more binary"
SCHEMA = pa.schema([("kind", pa.int8()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("sub", "docs", "runs", "low", "pos", "more")]])
#: Postings gathered by a task before it packs them, bytes of text for each part, and parts that a block is dealt to.
BLOCK, PART_BYTES, MOST_PARTS = 1 << 20, 4 << 20, 8192
NONE = np.zeros(0, np.uint8)


class Parts(NamedTuple):
    coarse: int
    fine: int

    @property
    def total(self) -> int:
        return self.coarse * self.fine


def parts_of(n_bytes: int) -> Parts:
    """How many parts hold the postings of so many bytes of text: in proportion to them, so a part's size stays the same."""
    total = max(64, n_bytes // PART_BYTES)
    fine = -(-total // MOST_PARTS)
    return Parts(-(-total // fine), fine)


def parts_for(docs: DataFrame, text: str) -> Parts:
    return parts_of(int(docs.agg(F.sum(F.octet_length(text)).alias("n")).collect()[0]["n"] or 0))


def part_of(hashes: np.ndarray, parts: Parts) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts.total) >> np.uint64(32)).astype(np.int32)


def bucket_of(docs: np.ndarray, parts: Parts) -> np.ndarray:
    return part_of(mix(docs.view(np.uint64)), parts)


def narrow(a: np.ndarray) -> np.ndarray:
    """As 16-bit numbers where they fit."""
    return a.astype(np.uint16 if len(a) == 0 or a.max() < 65536 else np.uint32)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary for each stretch of `values` between neighbouring bounds; empty ones where there are no values."""
    offsets = (bounds * values.itemsize if len(values) else np.zeros(len(bounds))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def pack(kind: int, part: np.ndarray, doc: np.ndarray, low: np.ndarray, pos: np.ndarray, more: np.ndarray = NONE, fine: int = 1) -> pa.RecordBatch:
    """One row for each part that occurs, or for each coarse part where `fine` parts make one. Empty arrays stand for fields that are not used."""
    coarse = part // fine if fine > 1 else part
    order = np.argsort(coarse, kind="stable")
    coarse, doc = coarse[order], doc[order]
    sub = (part[order] - coarse * fine).astype(np.uint16) if fine > 1 else NONE
    low, pos, more = (x[order] if len(x) else x for x in (low, pos, more))
    n = len(coarse)
    fresh = np.concatenate([np.ones(min(n, 1), bool), coarse[1:] != coarse[:-1]])
    cuts = np.flatnonzero(fresh)
    bounds = np.append(cuts, n)
    new = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), fresh[1:] | (doc[1:] != doc[:-1])]))
    runs, at = np.diff(np.append(new, n)).astype(np.uint32), np.searchsorted(new, bounds)
    fields = [_binary(sub, bounds), _binary(doc[new], at), _binary(runs, at), _binary(low, bounds), _binary(narrow(pos), bounds), _binary(more, bounds)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), kind, np.int8)), pa.array(coarse[cuts].astype(np.int32)), *fields], schema=SCHEMA)


def dealt(rows: DataFrame, parts: Parts, more: type = np.uint32) -> DataFrame:
    """The packed rows with their fine parts: those of coarse parts are gathered to blocks and packed anew. Rows of fine parts stay as they are."""
    if parts.fine == 1:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, Block] = {}  # by kind, and by which fields are used

        def flush(key: tuple) -> pa.RecordBatch:
            part, doc, low, pos, rest = blocks.pop(key).take()
            return pack(key[0], part, doc, *(x if used else NONE for x, used in zip((low, pos, rest), key[1:], strict=True)))

        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                sub = row.column("sub")[0].as_py()
                if not sub:
                    yield batch.slice(i, 1)
                    continue
                doc, low, pos, rest = unpack(row, more)
                key = (row.column("kind")[0].as_py(), len(low) > 0, len(pos) > 0, len(rest) > 0)
                part = row.column("part")[0].as_py() * parts.fine + np.frombuffer(sub, np.uint16).astype(np.int32)
                full = lambda x, t: x if len(x) else np.zeros(len(doc), t)
                if blocks.setdefault(key, Block()).add(part, doc, full(low, np.uint32), full(pos, np.uint32), full(rest, more)):
                    yield flush(key)
        for key in list(blocks):
            yield flush(key)

    return rows.repartition("part").mapInArrow(run, CHUNK)


def unpack(rows: pa.Table, more: type = np.uint32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All postings of the rows: (doc, low, pos, more); fields that were not used are empty."""
    doc, low, pos, rest = [], [], [], []
    for d, r, a, p, m in zip(*(rows.column(c).to_pylist() for c in ("docs", "runs", "low", "pos", "more")), strict=True):
        runs = np.frombuffer(r, np.uint32)
        doc.append(np.repeat(np.frombuffer(d, np.int64), runs))
        n = len(doc[-1])
        if a:
            low.append(np.frombuffer(a, np.uint32))
        if p:
            pos.append(np.frombuffer(p, np.uint16 if len(p) == 2 * n else np.uint32).astype(np.uint32))
        if m:
            rest.append(np.frombuffer(m, more))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(doc, np.int64), join(low, np.uint32), join(pos, np.uint32), join(rest, more)


def groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, np.zeros(0, np.int64)
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(change)


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n sorted items the number of its group."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def by_document(found: DataFrame, name: str, marks: bool = False) -> DataFrame:
    """(doc_id, `name`) from packed rows dealt by document: the sorted distinct places as a binary of 32-bit numbers.

    With `marks`, a second binary `marks` has the hash bits (`low`) of each place; a place with
    several comes several times.
    """

    def run(rows: pa.Table) -> pa.Table:
        doc, low, pos, _ = unpack(rows)
        keys = [doc, pos, low] if marks else [doc, pos]
        order, starts = groups(keys)
        doc, pos = doc[order][starts], pos[order][starts]
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        ends = [*new[1:], len(doc)] if len(new) else []
        out = {"doc_id": pa.array(doc[new], pa.int64()), name: pa.array([pos[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary())}
        if marks:
            low = low[order][starts]
            out["marks"] = pa.array([low[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary())
        return pa.table(out)

    return found.groupBy("part").applyInArrow(run, f"doc_id bigint, {name} binary" + ", marks binary" * marks)


class Block:
    """Gathers arrays until there are enough for a block."""

    def __init__(self, most: int = BLOCK):
        self.most, self.n, self.parts = most, 0, []

    def add(self, *arrays: np.ndarray) -> bool:
        self.parts.append(arrays)
        self.n += len(arrays[0])
        return self.n >= self.most

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.n, self.parts = 0, []
        return out


def texts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of bounded size, without rows whose doc_id or text is null."""
    from tutorlens.llm.words import slices

    for batch in batches:
        if batch.column("doc_id").null_count or batch.column(text).null_count:
            import pyarrow.compute as pc

            batch = batch.filter(pc.and_(batch.column("doc_id").is_valid(), batch.column(text).is_valid()))
        yield from slices(batch, text, most)
