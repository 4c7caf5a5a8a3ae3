"""Near-duplicates among embeddings: random-hyperplane hashing, exact cosines, components.

Every vector gets a sketch, the signs of its products with SKETCH random hyperplanes, and one short
code per table, which is a fixed choice of the sketch's bits. Bits and tables follow from the
number of vectors: a bucket keeps about the same size at every scale, and there are enough tables
for a pair right at the threshold to be met with the probability `recall`; closer pairs are met
more often.

What is dealt out once per table is a vector's id and its sketch, never the vector: 64 bytes at any
number of tables, as codes follow from it. In each bucket, sketches that differ in too many bits for
the threshold (seven standard deviations beyond what it lets expect) rule a pair out. Vectors are
joined only to the few ids that are left, each for the first table in which it shares a code with a
partner, and compared exactly there, in double precision, as blocks of one matrix product. So every
pair is judged by its cosine once.

Equal vectors are one class with a multiplicity, so copies cost nothing. A bucket that is large
is cut into blocks, and every pair of its blocks is dealt out on its own: nothing is dropped, no
task holds a whole large bucket, and pairs are counted inside the block, not sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.components import components
from tutorlens.llm.tables import settled, table

THRESHOLD, RECALL = 0.9, 0.98
#: Tables at most; 28 bits a code take fewer than half as many for a recall of 0.98 at a cosine of 0.9.
MOST_TABLES = 2000
#: Vectors in a usual bucket, and in a block of a large one.
BUCKET, BLOCK = 64, 1024
#: Bits of a sketch, rows whose signs are made at a time, rows that a task compares at a time, parts at least, and large buckets whose names may be broadcast (about 16 MB).
SKETCH, SLICE, ROWS_A_PART, LEAST_PARTS, BROADCAST_BUCKETS = 512, 1024, 40_000, 32, 500_000


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a code and number of tables for n vectors."""
    bits = min(28, max(4, math.ceil(math.log2(max(n, 1) / bucket)) if n > bucket else 4))
    # two sketches differ in a binomial number of bits; a table meets if none of its bits is among them
    p = math.acos(threshold) / math.pi
    differ = np.arange(SKETCH - bits + 1)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = np.exp([log(SKETCH, d) + d * math.log(p) + (SKETCH - d) * math.log1p(-p) for d in differ]) if p > 0 else (differ == 0).astype(float)
    meet = np.exp([log(SKETCH - d, bits) - log(SKETCH, bits) for d in differ])
    tables = 1
    while (chance * (1 - (1 - meet) ** tables)).sum() < recall and tables < MOST_TABLES:
        tables = max(tables + 1, tables * 21 // 20)
    return bits, tables


def planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, SKETCH))


def chosen(bits: int, tables: int, seed: int) -> np.ndarray:
    """The bits of the sketch that make the code of each table."""
    rng = np.random.default_rng([seed, bits])
    return np.stack([rng.choice(SKETCH, bits, replace=False) for _ in range(tables)])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies in [0.5, 1): squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """A matrix from a column of binaries of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), -1).view(kind)


def coded(classes: DataFrame, kind: type, bits: int, tables: int, seed: int) -> DataFrame:
    """(rep, m, dim, v, sketch, each) from (rep, m, e): the scaled vector, its signs as bits, and its code in each table."""

    which = chosen(bits, tables, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # hyperplanes for each length of vectors
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                dims = np.diff(batch.column("e").offsets.to_numpy())
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    x = scaled(part.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim))
                    if dim not in known:
                        known[dim] = planes(int(dim), seed)
                    on = x @ known[dim] > 0
                    codes = np.stack([(on[:, at].astype(np.int64) << np.arange(bits)).sum(axis=1) for at in which], axis=1)
                    columns = [part.column("rep"), part.column("m"), pa.array(np.full(len(x), dim, np.int32)), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in np.packbits(on, axis=1)], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["rep", "m", "dim", "v", "sketch", "each"])

    return classes.mapInArrow(run, "rep bigint, m bigint, dim int, v binary, sketch binary, each array<bigint>")


#: A block pair of a bucket.
_GROUP = ("t", "code", "dim", "i", "j")


def _buckets(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block pair in the rows: its table and the indices of its two sides, which are one where they are the same block."""
    keys = [rows.column(c).to_numpy() for c in _GROUP]
    side, i, j = rows.column("side").to_numpy(), keys[3], keys[4]
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    cuts = np.flatnonzero(change)
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        own = order[a:b]
        if len(own) > 1:
            first = own[0]
            if i[first] == j[first]:
                yield int(keys[0][first]), own, own
            else:
                yield int(keys[0][first]), own[side[own] == i[first]], own[side[own] == j[first]]


def _fresh(x: np.ndarray, y: np.ndarray, t: int, which: np.ndarray) -> np.ndarray:
    """Whether sketches that share their code in table t share none in the tables before."""
    out = np.ones(len(x), bool)
    alive = np.arange(len(x))
    apart = np.unpackbits((x ^ y).view(np.uint8), axis=1) if t and len(x) else None
    for at in which[:t]:  # near copies share a code in the first tables and are soon left out
        if not len(alive):
            break
        fresh = apart[alive][:, at].any(axis=1)
        out[alive[~fresh]] = False
        alive = alive[fresh]
    return out


def _near(threshold: float, which: np.ndarray):
    """Of the rows of some buckets, those that may link with another one there and share no code with it in an earlier table."""
    p = math.acos(threshold) / math.pi
    most = SKETCH * p + 7 * math.sqrt(SKETCH * p * (1 - p))

    def run(rows: pa.Table) -> pa.Table:
        sketch = _rows(rows.column("sketch"), np.uint64)
        on = np.zeros(rows.num_rows, bool)
        for t, a, b in _buckets(rows):
            y = sketch[b]
            for s in range(0, len(a), 64):
                own = a[s : s + 64]
                apart = np.bitwise_count(sketch[own][:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.uint16)
                near = apart <= most
                if a is b:
                    near &= np.arange(s, s + len(own))[:, None] < np.arange(len(b))[None, :]
                q, r = np.nonzero(near)
                keep = _fresh(sketch[own[q]], y[r], t, which)
                on[own[q[keep]]] = True
                on[b[r[keep]]] = True
        return rows.filter(pa.array(on)).select([*_GROUP, "side", "rep"])

    return run


def _compare(threshold: float, kind: type, which: np.ndarray):
    """For some buckets: kind 0 are (vector, number of vectors it links with), kind 1 links that join them."""

    def run(rows: pa.Table) -> pa.Table:
        rep, m = (rows.column(c).to_numpy() for c in ("rep", "m"))
        sketch = _rows(rows.column("sketch"), np.uint64)
        vectors = rows.column("v").combine_chunks()
        count, far, near_ = np.zeros(len(rep), np.int64), [], []
        for t, a, b in _buckets(rows):
            x, y = (_rows(vectors.take(pa.array(k)), kind).astype(np.float64) for k in (a, b))
            nx, ny = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y))
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for s in range(0, len(a), 256):
                near = (x[s : s + 256] @ y.T) / np.outer(nx[s : s + 256], ny) >= threshold
                if a is b:
                    near &= np.arange(s, s + len(near))[:, None] < np.arange(len(b))[None, :]
                p, q = np.nonzero(near)
                fresh = _fresh(sketch[a[p + s]], sketch[b[q]], t, which)
                np.add.at(count, a[p[fresh] + s], m[b[q[fresh]]])
                np.add.at(count, b[q[fresh]], m[a[p[fresh] + s]])
                links.append((a[p + s], b[q]))
            p, q = (np.concatenate(z) for z in zip(*links, strict=True))
            nodes, at = np.unique(np.r_[p, q], return_inverse=True)
            p, q, label = at[: len(p)], at[len(p) :], np.arange(len(nodes))
            while len(p):  # every vector takes the least label of its partners until none changes
                before = label.copy()
                np.minimum.at(label, p, label[q])
                np.minimum.at(label, q, label[p])
                label = label[label]
                if np.array_equal(label, before):
                    break
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            far.append(rep[nodes[moved]])
            near_.append(rep[nodes[label[moved]]])
        some = np.flatnonzero(count)
        far, near_ = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (far, near_))
        return pa.table({
            "kind": pa.array([0] * len(some) + [1] * len(far), pa.int8()),
            "a": pa.array(np.r_[rep[some], far], pa.int64()),
            "b": pa.array(np.r_[count[some], near_], pa.int64()),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`, which has vec_id and embedding.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    vectors of different lengths not with each other, and rows without vec_id with nothing
    (their component_id is null and kept is false). Components of any finite size are compared,
    as each vector is scaled by a power of two first. Repeated rows count as vectors of their
    own; unlike vectors that share a vec_id are one node. Other columns are not read; an empty
    table gives an empty one.
    """
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    good = vectors.filter(sound).withColumns({"k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(1), "e")})
    named = settled(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    n = named.count()
    bits, tables = shape(n, threshold, recall)
    which = chosen(bits, tables, seed)
    # copies meet after a map-side step that keeps one of each
    classes = good.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "e")).alias("x"), F.count("*").alias("m")).select("k1", "k2", F.col("x.vec_id").alias("rep"), "m", F.col("x.e").alias("e"))
    codes = settled(coded(classes.select("rep", "m", "e"), kind, bits, tables, seed))
    places = codes.select("rep", "dim", "sketch", F.posexplode("each").alias("t", "code"))
    # only the buckets that must be cut are known by name; they are few, as each has many vectors
    hot = settled(codes.select("dim", F.posexplode("each").alias("t", "code")).groupBy("t", "code", "dim").agg(F.count("*").alias("k")).filter(F.col("k") > BLOCK).select("t", "code", "dim", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    cut = places.join(F.broadcast(hot) if hot.count() <= BROADCAST_BUCKETS else hot, ["t", "code", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    side, other = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = cut.withColumn("side", side).withColumn("o", other).select("rep", "sketch", "t", "code", "dim", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side")
    dealt = lambda df, rows: df.withColumn("part", F.pmod(F.xxhash64(*_GROUP), F.lit(max(LEAST_PARTS, rows // ROWS_A_PART)))).groupBy("part")
    near = settled(dealt(placed, n * tables).applyInArrow(_near(threshold, which), "t int, code bigint, dim int, i int, j int, side int, rep bigint"))
    rows = near.join(codes.select("rep", "m", "v", "sketch"), "rep")
    found = settled(dealt(rows, 8 * near.count()).applyInArrow(_compare(threshold, kind, which), "kind tinyint, a bigint, b bigint"))
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    joined = components(found.filter("kind = 1").select("a", "b"))
    named = named.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("k1", "k2", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = good.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.filter(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
