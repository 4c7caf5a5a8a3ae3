"""A similarity join of documents on word shingles: Jaccard 0.8 or more, by a prefix-tree join.

1. Documents with equal shingle sets form a class; from here on its smallest document stands
   for it.
2. Every shingle's document frequency is counted over the whole corpus. Shingles of one
   document only link nothing, so a document of which less than 80 % is shared with others has
   no partner and is done.
   Shingles that very many documents share are found while sets are measured, by counts of
   blocks; there are 65,536 at most, so they are broadcast, and their postings meet nowhere.
3. Of the rest, shingles are ordered by frequency, then hash. Two documents that link share a
   shingle among the first n - ceil(0.8 n) + 1 of each, counting the unshared ones first: the
   prefix. Documents that share a prefix shingle are a bucket.
4. In each bucket all are first compared with the smallest only. Those comparisons are walks
   through a prefix tree of the members' sets, with the smallest as the query. Their links give
   components, so a bucket of thousands of near copies costs as many comparisons as it has
   members.
5. Buckets in which documents of several components are left are completed: every pair of such
   documents is compared, in the same way, so no component misses a link.

Sets are 64-bit hashes of shingles; a set's fingerprint has 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm import postings as P
from tutorlens.llm.components import components
from tutorlens.llm.prefix_tree import linked
from tutorlens.llm.tables import settled, table
from tutorlens.llm.words import mix, shingle_sets

WIDTH, PERCENT = 5, 80
#: Documents of a block that make a shingle count towards the heavy ones; the count at which the order by frequency goes over to that by hash.
HEAVY, MOST_COUNT = 8, 65_535
#: Sets of one prefix tree, about, and their bytes at most.
TREE, TREE_BYTES = 512, 8 << 20
#: Candidate ids that may be broadcast (about 16 MB).
BROADCAST_IDS = 1_000_000


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(own))
    return int(mix(np.array([own.sum(dtype=np.uint64) + n]))[0].view(np.int64)), int(mix(np.array([mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]))[0].view(np.int64))


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def set_sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(kind, doc_id, n_shingles, f1, f2): kind 0 is the size and fingerprint of each row's set.

    The same pass counts shingles for `heavy_shingles`: kind 1 is a shingle (f1) with its number of
    documents (n_shingles) in a block of a task where it has HEAVY or more, copies counted once;
    kind 2 says that there was a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tutorlens.llm.words import slices

        def rows(kind: int, ids: pa.Array, n: np.ndarray | list, f1: np.ndarray | list, f2: np.ndarray | list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int8)), ids, *[pa.array(x, pa.int64()) for x in (n, f1, f2)]], ["kind", "doc_id", "n_shingles", "f1", "f2"])

        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            h, n = np.r_[h[n >= HEAVY].view(np.int64), 0], np.r_[n[n >= HEAVY], 0]
            out = rows(1, pa.nulls(len(h), pa.int64()), n, h, np.zeros(len(h), np.int64))
            return out.set_column(0, "kind", pa.array(np.r_[np.full(len(h) - 1, 1, np.int8), np.int8(2)]))

        seen, parts, size = set(), [], 0
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, f1, f2 = [], [], []
                for own in shingle_sets(batch.column("text"), width):
                    a, b = _fingerprint(own)
                    n.append(len(own)), f1.append(a), f2.append(b)
                    if len(own) and a not in seen:
                        seen.add(a)
                        parts.append(own)
                        size += len(own)
                yield rows(0, batch.column("doc_id"), n, f1, f2)
                if size >= P.BLOCK:
                    yield counted(parts)
                    seen, parts, size = set(), [], 0
        if size:
            yield counted(parts)

    return docs.mapInArrow(run, "kind tinyint, doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint")


def heavy_shingles(sized: DataFrame) -> np.ndarray:
    """The sorted hashes of shingles that very many documents share, from the rows of `set_sizes`.

    They have 2 * HEAVY documents a block on the mean, counting only blocks with HEAVY or more;
    so every shingle with 3 * HEAVY a block is among them, and as a block has about P.BLOCK
    postings, there are P.BLOCK / (2 * HEAVY) = 65,536 at most, at any size of the corpus.
    """
    blocks = sized.filter("kind = 2").count()
    heavy = sized.filter("kind = 1").groupBy("f1").agg(F.sum("n_shingles").alias("n")).filter(F.col("n") >= 2 * HEAVY * max(blocks, 1))
    return np.sort(np.array([r["f1"] for r in heavy.select("f1").collect()], np.int64).view(np.uint64))


def shared_shingles(docs: DataFrame, heavy: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, shared, rarest): how many shingles occur in other documents too, and the rarest of these in order.

    No more than the prefix can need is kept, about a fifth. Copies within a block of a task
    count once: the smallest posts for them. Postings of `heavy` shingles do not meet: they are
    known to be shared, come last in the order, and go straight to their documents.
    """
    parts = P.parts_for(docs, "text")
    known = docs.sparkSession.sparkContext.broadcast(heavy)  # 65,536 hashes at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heavy = P.Block(), known.value

        def flush() -> Iterator[pa.RecordBatch]:
            h, d, f = block.take()
            least: dict[int, int] = {}
            ids, at = np.unique(d, return_index=True)
            for doc, print_ in zip(ids.tolist(), f[at].tolist(), strict=True):
                least[print_] = min(least.get(print_, doc), doc)
            on = np.isin(d, np.fromiter(least.values(), np.int64))
            h, d = h[on], d[on]
            if len(heavy):
                hot = heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h
                if hot.any():
                    w, e = h[hot], d[hot]
                    yield P.pack(1, P.bucket_of(e, parts), e, (w & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.full(len(w), MOST_COUNT, np.uint32), P.part_of(w, parts).astype(np.uint32), parts.fine)
                    h, d = h[~hot], d[~hot]
            yield P.pack(0, P.part_of(h, parts), d, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), P.NONE, fine=parts.fine)

        for batch in P.texts(batches):
            sets = list(shingle_sets(batch.column("text"), width))
            sizes = [len(s) for s in sets]
            if sum(sizes) and block.add(np.concatenate(sets), np.repeat(_doc_ids(batch), sizes), np.repeat(np.array([_fingerprint(s)[0] for s in sets], np.int64), sizes)):
                yield from flush()
        if block.n:
            yield from flush()

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            return rows
        doc, low, _, _ = P.unpack(rows)
        order, starts = P.groups([low])
        d, m = doc[order], low[order]
        common = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts) if len(starts) else np.zeros(0, bool)
        count = np.diff(np.r_[starts, len(d)])
        group = P.spread(starts, len(d)) if len(d) else np.zeros(0, np.int64)
        on = common[group]
        d, m, c = d[on], m[on], np.minimum(count[group][on], MOST_COUNT).astype(np.uint32)
        order = np.argsort(d, kind="stable")
        packed = P.pack(1, P.bucket_of(d[order], parts), d[order], m[order], c[order], np.full(len(d), key[1].as_py(), np.uint32), parts.fine)
        return pa.Table.from_batches([packed], schema=P.SCHEMA)

    def gather(rows: pa.Table) -> pa.Table:
        doc, low, count, part = P.unpack(rows)
        token = (part.astype(np.uint64) << np.uint64(32) | low).view(np.int64)
        order = np.lexsort((token, count, doc))
        doc, token = doc[order], token[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])] if len(doc) else np.zeros(0, bool)
        doc, token = doc[once], token[once]  # rows that repeat a document may have posted from several blocks
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        shared = np.diff(np.r_[new, len(doc)])
        need = [token[a : a + n - -(-percent * n // 100) + 1] for a, n in zip(new, shared, strict=True)]
        return pa.table({"doc_id": pa.array(doc[new], pa.int64()), "shared": pa.array(shared, pa.int64()), "rarest": pa.array(need, pa.list_(pa.int64()))})

    met = P.dealt(docs.mapInArrow(emit, P.CHUNK), parts).groupBy("kind", "part").applyInArrow(meet, P.CHUNK)
    return P.dealt(met, parts).groupBy("part").applyInArrow(gather, "doc_id bigint, shared bigint, rarest array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams) for the documents in `ids`: the sorted set as a binary of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in P.texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), width)], pa.binary())], ["doc_id", "grams"])

    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(few, "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, grams binary")


def trees(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, chunk, b, grams) in the order in which `verified` reads them: for each `a` and chunk of its partners the set of `a` first, with null for b, then theirs.

    The partners of one `a` are dealt into chunks of about TREE sets, so a group of any size is
    spread over tasks, and each chunk is together in one, whatever joins Spark chooses before.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("k"))
    each = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / TREE)).cast("int").alias("chunk"))
    theirs = each.join(sets.select(F.col("doc_id").alias("b"), "grams"), "b").select("a", "chunk", "b", "grams")
    queries = each.select("a", "chunk").distinct().join(sets.select(F.col("doc_id").alias("a"), "grams"), "a")
    both = theirs.unionByName(queries.select("a", "chunk", F.lit(None).cast("bigint").alias("b"), "grams"))
    return both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. The partners of one `a` form prefix trees that `a` walks; a task holds one tree, up to 8 MB of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, members, held = None, None, [], 0

        def walked() -> pa.RecordBatch:
            found = [members[i][0] for i in linked(query, [m[1] for m in members], percent)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), now[0]), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, chunk, b, grams in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b", "grams")), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if members and (now != (a, chunk) or held > TREE_BYTES):
                    yield walked()
                    members, held = [], 0
                if b is None:
                    now, query = (a, chunk), own
                else:
                    members.append((b, own))
                    held += len(grams)
        if members:
            yield walked()

    return trees(pairs, sets).mapInArrow(run, "a bigint, b bigint")


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`, which has doc_id and text.

    Two documents link when their shingle sets overlap by `percent` of the union or more;
    component_id is the smallest doc_id that links reach, the document itself included. Texts
    without words, null ones included, link with nothing, and so do rows without doc_id, whose
    component_id is null. Repeated rows are copies of each other. Texts are cut whole, however
    long: a task works on slices of about 2 MB, and a longer text is a slice of its own. Other
    columns are not read.
    """
    docs = docs.select("doc_id", "text")
    sized = settled(set_sizes(docs, width))
    heavy = heavy_shingles(sized)
    sized = sized.filter("kind = 0").drop("kind")
    known = sized.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = settled(known.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    prefixed = (
        shared_shingles(docs, heavy, width, percent)
        .join(classes.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n")), "doc_id")
        .filter(F.col("shared") >= need)
        .select("doc_id", "n", (F.col("n") - F.col("shared")).alias("alone"), F.posexplode(F.slice("rarest", 1, (F.col("shared") - need + 1).cast("int"))).alias("at", "token"))
        # how many tokens of the document can still match from this one on; the unshared ones come first and cannot
        .select("doc_id", "n", "token", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
    )
    prefixed = settled(prefixed)

    def fits(x: str, y: str) -> F.Column:
        """Whether a pair can link if this token is its first in common: both must have as much left as the overlap that is asked for."""
        asked = F.ceil((F.col(f"{x}.n") + F.col(f"{y}.n")) * percent / (100 + percent) - 1e-9)
        return F.least(F.col(f"{x}.left"), F.col(f"{y}.left")) >= asked

    stars = prefixed.groupBy("token").agg(F.min(F.struct("doc_id", "n", "left")).alias("s"), F.count("*").alias("k")).filter("k > 1")
    members = prefixed.alias("m").join(stars, "token")
    involved = settled(members.select("m.doc_id").distinct())
    sets = settled(sets_of(docs, involved, width))
    star_pairs = members.filter((F.col("m.doc_id") != F.col("s.doc_id")) & fits("m", "s")).select(F.col("s.doc_id").alias("a"), F.col("m.doc_id").alias("b")).distinct()
    star_pairs = settled(star_pairs)
    links = settled(verified(star_pairs, sets, percent))
    first = components(links)
    placed = prefixed.join(first, prefixed["doc_id"] == first["node"], "left").select("doc_id", "n", "left", "token", F.coalesce("component_id", "doc_id").alias("c"))
    split = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("token")
    open_ = settled(placed.join(split, "token", "left_semi"))
    x, y = open_.alias("x"), open_.alias("y")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.c") != F.col("y.c")) & fits("x", "y"))
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(star_pairs, ["a", "b"], "left_anti")
    more = settled(verified(rest, sets, percent))
    merged = first.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(more)
    final = components(merged) if not more.isEmpty() else first
    named = classes.join(final, classes["rep"] == final["node"], "left").select("n_shingles", "f1", "f2", F.coalesce("component_id", "rep").alias("component_id"))
    # texts without words have no class, and no row of it to meet in one task
    alone = sized.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.join(named, ["n_shingles", "f1", "f2"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), {WIDTH}) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
