"""Removal of passages that repeat across documents, found through difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: whatever two positions a match begins at, within the
next seven there is a shift that brings both to cover positions. So of any passage of 13 words
that two documents share, they share a 7-word anchor that begins at a cover position of each,
and hashing three windows in seven finds every such passage.

1. Anchors at cover positions are hashed; those that occur in two documents or more are shared.
2. A document's shared anchors are extended: only the 13-word windows around them are hashed
   in full (96 bits), and each is compared with the smallest doc_id in which it starts.
3. Words under a window that also starts in a smaller document are removed.

Before anything is shuffled, copies inside one block of a task are settled there, and of any
hash one document a block goes on, so a passage that a third of all documents share sends as
many postings as there are blocks, not as many as there are documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm import postings as P
from tutorlens.llm.tables import settled, table
from tutorlens.llm.words import slices, windows, words

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _shared_in_block(hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray, parts: P.Parts) -> Iterator[pa.RecordBatch]:
    """Kind 1: places already known to be shared, by document. Kind 0: postings that other blocks must see, by hash."""
    order, starts = P.groups([hashes, doc])
    h, d, p = hashes[order], doc[order], pos[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    group = P.spread(first, len(h))
    common = (d[first] != d[np.r_[first[1:], len(h)] - 1])[group]
    if common.any():
        yield P.pack(1, P.bucket_of(d[common], parts), d[common], P.NONE, p[common], fine=parts.fine)
    on = ~common
    on[first] = True
    back = np.argsort(order[on], kind="stable")  # document order again, for longer runs
    h, d, p = h[on][back], d[on][back], p[on][back]
    yield P.pack(0, P.part_of(h, parts), d, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), p, fine=parts.fine)


def shared_anchors(docs: DataFrame, parts: P.Parts) -> DataFrame:
    """(doc_id, anchors): the places of a document's anchors that occur in another document too.

    The hashes that decide have 32 bits and those of the part; a chance match only proposes
    windows that step 2 then rejects.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = P.Block()
        for batch in P.texts(batches):
            hashes, starts = words(batch.column("text"), fold=False)
            h, at = windows(hashes, starts, ANCHOR)
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[at]
            place = at - starts[row]
            cover = _IN_COVER[place % PERIOD]
            if block.add(h[cover], _doc_ids(batch)[row[cover]], place[cover].astype(np.uint32)):
                yield from _shared_in_block(*block.take(), parts)
        if block.n:
            yield from _shared_in_block(*block.take(), parts)

    def meet(rows: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or rows.column("kind")[0].as_py() == 1:
            return rows
        doc, low, pos, _ = P.unpack(rows)
        order, starts = P.groups([low])
        d = doc[order]
        common = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        common = common[P.spread(starts, len(d))]
        d, p = d[common], pos[order][common]
        order = np.lexsort((p, d))
        return pa.Table.from_batches([P.pack(1, P.bucket_of(d[order], parts), d[order], P.NONE, p[order], fine=parts.fine)], schema=P.SCHEMA)

    met = P.dealt(docs.mapInArrow(emit, P.CHUNK), parts).groupBy("kind", "part").applyInArrow(meet, P.CHUNK)
    return P.by_document(P.dealt(met, parts), "anchors")


def _repeats_in_block(high: np.ndarray, low: np.ndarray, doc: np.ndarray, pos: np.ndarray, parts: P.Parts, marks: bool) -> Iterator[pa.RecordBatch]:
    """Kind 1: windows that start in a smaller document of this block. Kind 0: those of the block's smallest, for the others."""
    order, _ = P.groups([high, low, doc])
    h, m, d, p = high[order], low[order], doc[order], pos[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
    later = d != d[first][P.spread(first, len(d))]
    if later.any():
        yield P.pack(1, P.bucket_of(d[later], parts), d[later], m[later] if marks else P.NONE, p[later], fine=parts.fine)
    on = ~later
    back = np.argsort(order[on], kind="stable")
    h, m, d, p = h[on][back], m[on][back], d[on][back], p[on][back]
    yield P.pack(0, P.part_of(h, parts), d, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), p, m, parts.fine)


def repeated_windows(anchored: DataFrame, parts: P.Parts, marks: bool = False) -> DataFrame:
    """(doc_id, repeats): the places of windows that also start in a document with a smaller doc_id; with `marks`, 32 bits of each one's hash too.

    `anchored` has doc_id, text and anchors, null for documents without. Only windows that hold a shared anchor are hashed.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = P.Block(P.BLOCK // 2)
        for batch in P.texts(b.filter(b.column("anchors").is_valid()) for b in batches):
            hashes, starts = words(batch.column("text"), fold=False)
            near = np.zeros(len(hashes) + 1, bool)
            for i, own in enumerate(batch.column("anchors").to_pylist()):
                if own:
                    # an anchor lies in the windows that begin up to six words before it
                    at = np.frombuffer(own, np.uint32).astype(np.int64)[:, None] - np.arange(PERIOD)[None, :]
                    at = at[(at >= 0) & (at <= starts[i + 1] - starts[i] - WINDOW)]
                    near[starts[i] + at] = True
            h, at = windows(hashes, starts, WINDOW)
            m, _ = windows(hashes, starts, WINDOW, seed=1)
            kept = near[at]
            h, m, at = h[kept], m[kept], at[kept]
            row = np.searchsorted(starts, at, side="right") - 1
            if len(h) and block.add(h, (m >> np.uint64(32)).astype(np.uint32), _doc_ids(batch)[row], (at - starts[row]).astype(np.uint32)):
                yield from _repeats_in_block(*block.take(), parts, marks)
        if block.n:
            yield from _repeats_in_block(*block.take(), parts, marks)

    def meet(rows: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or rows.column("kind")[0].as_py() == 1:
            return rows
        doc, low, pos, more = P.unpack(rows)
        order, starts = P.groups([low, more])
        d = doc[order]
        later = d != np.minimum.reduceat(d, starts)[P.spread(starts, len(d))]
        d, p, m = d[later], pos[order][later], more[order][later]
        order = np.lexsort((p, d))
        return pa.Table.from_batches([P.pack(1, P.bucket_of(d[order], parts), d[order], m[order] if marks else P.NONE, p[order], fine=parts.fine)], schema=P.SCHEMA)

    met = P.dealt(anchored.mapInArrow(emit, P.CHUNK), parts).groupBy("kind", "part").applyInArrow(meet, P.CHUNK)
    return P.by_document(P.dealt(met, parts), "repeats", marks)


def _marked(batch: pa.RecordBatch) -> list[bytes | None]:
    """The repeats of each row that its own text has at that place: those of another row with its doc_id are left out."""
    hashes, starts = words(batch.column("text"), fold=False)
    m, at = windows(hashes, starts, WINDOW, seed=1)
    out: list[bytes | None] = []
    for i, (places, marks) in enumerate(zip(batch.column("repeats").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
        if places:
            p = np.frombuffer(places, np.uint32).astype(np.int64)
            a, b = np.searchsorted(at, [starts[i], starts[i + 1]])
            place, own = at[a:b] - starts[i], (m[a:b] >> np.uint64(32)).astype(np.uint32)
            k = np.minimum(np.searchsorted(place, p), max(len(place) - 1, 0))
            same = (place[k] == p) & (own[k] == np.frombuffer(marks, np.uint32)) if len(place) else np.zeros(len(p), bool)
            places = np.unique(p[same]).astype(np.uint32).tobytes()
        out.append(places)
    return out


def _kept_words(text: str, repeats: bytes | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space. Bytes split exactly at space and the controls 9 to 13."""
    own = text.encode().split()
    if not repeats:
        return len(own), 0, b" ".join(own)
    gone = np.zeros(len(own) + 1, np.int64)
    at = np.frombuffer(repeats, np.uint32).astype(np.int64)
    at = at[at + WINDOW <= len(own)]
    np.add.at(gone, at, 1)
    np.add.at(gone, at + WINDOW, -1)
    gone = np.cumsum(gone[:-1]) > 0
    return len(own), int(gone.sum()), b" ".join(w for w, g in zip(own, gone, strict=True) if not g)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of `docs`, which has doc_id and text.

    `kept` are the words that are left, joined by one space. Null and empty texts have no words
    and an empty `kept`; texts of any length are compared whole. Rows without doc_id are compared
    with nothing and keep their words. Rows that repeat a doc_id do not remove each other's words.
    Where such rows differ in text, which is looked for first, places are told apart by the hash
    of their window, so each row loses its own repeats only. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    parts = P.parts_for(docs, "text")
    body = F.xxhash64("text")
    marks = not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(body).alias("low"), F.max(body).alias("high")).filter("low <> high").isEmpty()
    anchors = settled(shared_anchors(docs, parts))
    # both joins are left joins of the same table on doc_id, so Spark deals out the texts once
    known = docs.filter("doc_id IS NOT NULL")
    repeats = repeated_windows(known.join(anchors, "doc_id", "left"), parts, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                repeats = _marked(batch) if marks else batch.column("repeats").to_pylist()
                out = [_kept_words(t or "", r) for t, r in zip(batch.column("text").to_pylist(), repeats, strict=True)]
                n, gone, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    # rows without id meet nothing, and stay where they are
    alone = docs.filter("doc_id IS NULL").withColumn("repeats", F.lit(None).cast("binary"))
    alone = alone.withColumn("marks", F.lit(None).cast("binary")) if marks else alone
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return known.join(repeats, "doc_id", "left").mapInArrow(run, out).unionByName(alone.mapInArrow(run, out))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, hash(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS q FROM x JOIN m USING (g) WHERE least < doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
