"""Sharding as a transport problem: move the fewest bytes from old shards to new capacities.

A shard's rows are cut into blocks by a hash. The sizes of old shards and the capacities of
new ones make a small network; its minimum-cost flow says how many bytes each old shard sends
to each new one, where staying costs nothing. Whole blocks are then chosen to carry those
flows, so only the shards that send or receive are rewritten.

The network has (shards x shards) edges and the block table (shards x blocks) rows, both set
by parameters: they, and nothing else, are worked on by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.llm.tables import added, settled, table

SHARDS, BLOCKS = 16, 256
#: A text whose rows take more than this part of a shard's share is cut into pieces.
WHOLE = 64
#: Rows numbered by one task at a time.
ROWS_A_RUN = 5_000
#: Runs of rows whose first slots may be broadcast (a few numbers each, about 10 MB).
BROADCAST_RUNS = 100_000


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[float]] | None = None) -> dict[tuple[int, int], int]:
    """How much each supplier sends to each taker, {(i, j): amount}, at the least total cost.

    Without `cost`, sending i to i is free and any other byte costs 1. Successive shortest
    paths in the residual network; needs sum(capacity) >= sum(supply).
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities do not hold the supply")
    price = lambda i, j: float(i != j) if cost is None else cost[i][j]
    start, end = n + m, n + m + 1
    edges: list[list] = []  # [from, to, room, price]; an edge and its reverse stand side by side
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, c: float) -> None:
        for x in ([a, b, room, c], [b, a, 0, -c]):
            out[x[0]].append(len(edges))
            edges.append(x)

    for i in range(n):
        add(start, i, int(supply[i]), 0)
        for j in range(m):
            add(i, n + j, int(min(supply[i], capacity[j])), price(i, j))
    for j in range(m):
        add(n + j, end, int(capacity[j]), 0)
    while True:
        far, via, queue = [float("inf")] * (n + m + 2), [-1] * (n + m + 2), [start]
        far[start] = 0
        while queue:
            a = queue.pop(0)
            for e in out[a]:
                if edges[e][2] and far[a] + edges[e][3] < far[edges[e][1]] - 1e-9:
                    far[edges[e][1]], via[edges[e][1]] = far[a] + edges[e][3], e
                    if edges[e][1] not in queue:
                        queue.append(edges[e][1])
        if via[end] < 0:
            break
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = edges[via[b]][0]
        room = min(edges[e][2] for e in path)
        for e in path:
            edges[e][2] -= room
            edges[e ^ 1][2] += room
    return {(a, b - n): edges[e ^ 1][2] for e, (a, b, _, _) in enumerate(edges) if e % 2 == 0 and a < n and edges[e ^ 1][2]}


def transfers(blocks: dict[tuple[int, int], int], capacity: Sequence[int], cost: Sequence[Sequence[float]] | None = None) -> dict[tuple[int, int], int]:
    """The new shard of each block {(old shard, block): shard}, from block sizes in bytes.

    Flows are filled with the sender's largest blocks that still fit; what then remains is
    evened out by single blocks that bring a sender and a taker nearer to their capacities.
    """
    n = max([len(capacity), *(s + 1 for s, _ in blocks)])
    have = [0] * n
    for (s, _), size in blocks.items():
        have[s] += size
    flows = min_cost_flow(have, capacity, cost)
    to = {k: k[0] for k in blocks}
    for (i, j), amount in sorted(flows.items()):
        if i == j and i < len(capacity):
            continue
        for size, k in sorted(((v, k) for k, v in blocks.items() if k[0] == i and to[k] == i), reverse=True):
            if size <= amount:
                to[k], amount = j, amount - size
    gone = [k for k in blocks if to[k] >= len(capacity)]  # a dropped shard keeps nothing
    now = [0] * n
    for k, s in to.items():
        now[s] += blocks[k] if s < len(capacity) else 0
    for k in sorted(gone, key=lambda k: (-blocks[k], k)):
        to[k] = max(range(len(capacity)), key=lambda j: (capacity[j] - now[j], -j))
        now[to[k]] += blocks[k]
    while True:  # every move lowers the sum of squared misses by whole bytes, so this ends
        over = max(range(len(capacity)), key=lambda j: (now[j] - capacity[j], -j))
        under = max(range(len(capacity)), key=lambda j: (capacity[j] - now[j], -j))
        gap = min(now[over] - capacity[over], capacity[under] - now[under])
        fits = [(blocks[k], k) for k in blocks if to[k] == over and 0 < blocks[k] < 2 * max(gap, 0)]
        if not fits:
            return to
        size, k = min(fits, key=lambda f: (abs(f[0] - gap), f[1]))
        to[k] = under
        now[over] -= size
        now[under] += size


def even(total: int, shards: int) -> list[int]:
    """Capacities that share `total` as evenly as whole bytes allow."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(rows: DataFrame, size: str, old: str, spread: str, order: str, shards: int = SHARDS, capacity: Sequence[int] | None = None, blocks: int = BLOCKS, cost: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """`rows` with __sh_block, __sh_new (the new shard) and __sh_slot (its place there, without gaps from 0).

    `size`, `old`, `spread` and `order` name columns: bytes, the old shard's number, a hash that
    cuts a shard into blocks (rows that are equal in it stay together), and a hash of the row, by
    which it has its place. Without `capacity`, all bytes are shared evenly. Numbering runs inside
    small runs of rows and adds what comes before each run, so no shard is ever sorted as a whole.
    Rows equal in `order` and size are interchangeable, and lie in one run. Rows without an old
    shard are refused. Names that begin with __sh_ are kept for this function; an empty table
    stays empty.
    """
    cut = rows.withColumn("__sh_block", F.pmod(F.col(spread), F.lit(blocks)).cast("int"))
    counts = cut.groupBy(old, "__sh_block").agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()  # shards x blocks rows
    if any(r[old] is None for r in counts):
        raise ValueError("rows without an old shard; give them one first")
    sizes = {(r[old], r["__sh_block"]): r["bytes"] for r in counts}
    capacity = capacity or even(sum(sizes.values()), shards)
    to = transfers(sizes, capacity, cost)
    moves = rows.sparkSession.createDataFrame([(*k, s) for k, s in sorted(to.items())], "__sh_from int, __sh_of int, __sh_new int")
    placed = cut.join(F.broadcast(moves), (F.col(old) == F.col("__sh_from")) & (F.col("__sh_block") == F.col("__sh_of"))).drop("__sh_from", "__sh_of")
    # as many runs as a block of its rows needs, however unlike blocks are
    runs = rows.sparkSession.createDataFrame([(r[old], r["__sh_block"], -(-r["n"] // ROWS_A_RUN)) for r in counts], "__sh_from int, __sh_of int, __sh_runs bigint")
    placed = placed.join(F.broadcast(runs), (F.col(old) == F.col("__sh_from")) & (F.col("__sh_block") == F.col("__sh_of"))).drop("__sh_from", "__sh_of")
    placed = placed.withColumn("__sh_run", F.pmod(F.col(order), F.col("__sh_runs"))).drop("__sh_runs")
    run = [old, "__sh_block", "__sh_run"]
    before = placed.groupBy("__sh_new", *run).agg(F.count("*").alias("__sh_n"))
    before = before.select(*[F.col(c).alias(f"{c}__sh_r") for c in run], (F.sum("__sh_n").over(Window.partitionBy("__sh_new").orderBy(*run)) - F.col("__sh_n")).alias("__sh_first"))
    numbered = placed.withColumn("__sh_place", F.row_number().over(Window.partitionBy(*run).orderBy(order, size)) - 1)
    same = [F.col(c) == F.col(f"{c}__sh_r") for c in run]
    out = numbered.join(F.broadcast(before) if sum(-(-r["n"] // ROWS_A_RUN) for r in counts) <= BROADCAST_RUNS else before, same[0] & same[1] & same[2])
    return out.withColumn("__sh_slot", (F.col("__sh_first") + F.col("__sh_place")).cast("bigint")).drop("__sh_first", "__sh_place", "__sh_run", *[f"{c}__sh_r" for c in run])


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """`docs` with __sh_size (UTF-8 bytes of the text and 1; 1 for null), __sh_crc32, __sh_old, __sh_at and __sh_key, a hash of id and text.

    __sh_old and __sh_at, the shard and the block, are hashes of the text, so rows of equal texts
    are together. Only a text whose rows take more than a 64th of a shard's share, of which there
    are 64 * shards at most, is cut by ids into pieces of about that size.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.withColumns({
        "__sh_size": (F.octet_length(body) + 1).cast("bigint"), "__sh_crc32": F.crc32(body.cast("binary")),
        "__sh_text": F.xxhash64(F.lit("text"), body), "__sh_key": F.xxhash64(F.lit("row"), F.col(doc_id), F.col(text)),
    })
    share = F.greatest(F.lit(1.0), F.lit((own.agg(F.sum("__sh_size").alias("n")).collect()[0]["n"] or 0) / (shards * WHOLE)))
    large = own.groupBy(F.col("__sh_text").alias("__sh_of")).agg(F.sum("__sh_size").alias("n")).filter(F.col("n") > share)
    large = large.select("__sh_of", F.ceil(F.col("n") / share).alias("__sh_pieces"))
    cut = own.join(F.broadcast(large), F.col("__sh_text") == F.col("__sh_of"), "left")
    piece = F.pmod(F.col("__sh_key"), F.coalesce("__sh_pieces", F.lit(1)))
    old, at = F.pmod(F.xxhash64(F.lit("shard"), "__sh_text", piece), F.lit(shards)).cast("int"), F.xxhash64(F.lit("block"), "__sh_text", piece)
    return cut.withColumns({"__sh_old": old, "__sh_at": at}).drop("__sh_text", "__sh_of", "__sh_pieces")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """`docs` with size, text_crc32, old_shard, block, shard and slot under the law `bytes`: shards near equal in bytes.

    A column of the caller is never replaced: where it has the name of a new one, the new one
    gets an underscore behind its name. A null text has size 1; rows of any length stay whole,
    so one text larger than a shard's share makes that shard larger. Rows of equal texts get one
    shard, unless together they take more than a 64th of a shard's share.
    """
    names = added(docs, "size", "text_crc32", "old_shard", "block", "shard", "slot")
    out = reshard(sized(docs, doc_id, text, shards), "__sh_size", "__sh_old", "__sh_at", "__sh_key", shards)
    own = ("__sh_size", "__sh_crc32", "__sh_old", "__sh_block", "__sh_new", "__sh_slot")
    return out.select(*docs.columns, *[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])


def rewrite(spark: SparkSession, source: str, target: str, shards: int, doc_id: str = "doc_id", text: str = "text", capacity: Sequence[int] | None = None) -> dict[int, str]:
    """Reshards the folder `source` (shard=N below it) into at most `shards` shards; {shard: folder of its files}.

    Shards that neither send nor receive a block keep their old files; the others are written
    anew below `target`.
    """
    rows = spark.read.parquet(source).withColumnRenamed("shard", "__sh_was")
    columns = [c for c in rows.columns if c not in ("__sh_was", "slot")]
    rows = sized(rows.drop("slot"), doc_id, text).withColumn("__sh_old", F.col("__sh_was").cast("int"))
    new = reshard(rows, "__sh_size", "__sh_old", "__sh_at", "__sh_key", shards, capacity)
    moved = new.filter(F.col("__sh_new") != F.col("__sh_old")).select(F.explode(F.array("__sh_new", "__sh_old")).alias("s")).distinct()
    touched = sorted(r["s"] for r in moved.collect())  # shard numbers only
    old = sorted(r["__sh_old"] for r in rows.select("__sh_old").distinct().collect())
    if touched:
        new.filter(F.col("__sh_new").isin(touched)).select(*columns, F.col("__sh_slot").alias("slot"), F.col("__sh_new").alias("shard")).write.partitionBy("shard").mode("errorifexists").parquet(target)
    return {s: f"{target if s in touched else source}/shard={s}" for s in range(shards) if s in touched or s in old}


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = reshard(settled(sized(docs).drop("text")), "__sh_size", "__sh_old", "__sh_at", "__sh_key")
    return placed.select(
        "doc_id", F.col("__sh_size").alias("size"), F.col("__sh_crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__sh_new").alias("shard"), F.col("__sh_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law and the slots promise of op8's result, in numbers that SQL knows from the input alone."""
    rows = op8_reshard(spark, sf_dir)
    by_shard = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
    mean = F.sum("bytes") / SHARDS
    return by_shard.agg(
        F.sum("n").cast("bigint").alias("n_rows"), F.sum("bytes").cast("bigint").alias("n_bytes"), F.count("*").alias("n_shards"),
        F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"),
        F.coalesce((F.max("bytes") < 1.05 * mean) & (F.min("bytes") > 0.95 * mean), F.lit(True)).alias("near_equal"),
    )


LAWS_ORACLE = f"SELECT count(*) AS n_rows, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, CAST({SHARDS} AS BIGINT) AS n_shards, true AS gapless, true AS near_equal FROM documents"
