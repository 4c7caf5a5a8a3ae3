"""Ranked lexical search: the k best documents of each query by a sum over its terms, with TPUT over term-partitioned postings.

1. Texts are read once. Each posting (term, document, occurrences) goes to a table; a document is
   known there by its place in the scan, so rows that share an id stay apart.
2. With the corpus's totals every posting gets its share of a score, and the postings are written
   again, dealt by ranges of (term, share): a term's list is sorted by share, and that of a
   frequent term stretches over several files.
3. The heads of the lists, k postings each, give every query k documents with known parts of
   their scores; the k-th is a lower bound of the k-th score.
4. Every list is fetched down to one threshold for all lists of a query: documents that lie below
   it everywhere cannot reach the bound. What is fetched is dealt by blocks of documents and added
   up, twice: first each block gives its k highest sums above the bound, and the k-th of all is
   the next bound; then it gives the documents whose sum, with the most that unfetched lists could
   add, reaches that bound.
5. The exact scores of the rest are looked up in the lists.

Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tutorlens.llm.tables import fresh_folder, settled, table
from tutorlens.llm.words import NOT_TERM, slices, words

K = 20
#: (query, term) rows that one pass serves, and terms or candidate documents that may be broadcast (8 to 40 MB).
PASS_ROWS = BROADCAST_ROWS = 1_000_000
#: Documents whose sums are made together, as a power of two.
BLOCK_BITS = 13
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, mult): for each query its terms with their repeats; `item` stands for the query's id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = words(batch.column("text"), True, NOT_TERM)
            item = np.repeat(batch.column("item").to_numpy(), np.diff(starts))
            at = np.lexsort((hashes, item))
            h, i = hashes[at], item[at]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])]) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(i[new]), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.r_[new, len(h)]))], ["item", "term", "mult"])

    keyed = items.select(_item(item_id, text).alias("item"), F.col(text).alias("text")).distinct()
    return keyed.mapInArrow(run, "item bigint, term bigint, mult bigint")


def _item(item_id: str, text: str) -> F.Column:
    return F.xxhash64(F.col(item_id).isNull(), item_id, F.col(text).isNull(), text)


def postings(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """(term, key, doc_id, tf, n): one row for each document and term, and one without term for each document with terms.

    `n` are all terms of the document with repeats. With `terms`, sorted hashes, only those are
    posted. `key` is the place in this scan: keep the rows before they are used twice.
    """
    known = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                hashes, starts = words(batch.column("text"), True, NOT_TERM)
                n = np.diff(starts)
                row = np.repeat(np.arange(len(n)), n)
                if known is not None:
                    own = known.value
                    at = np.searchsorted(own, hashes)
                    on = own[np.minimum(at, len(own) - 1)] == hashes if len(own) else np.zeros(len(hashes), bool)
                    hashes, row = hashes[on], row[on]
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(hashes) else np.zeros(0, np.int64)
                tf, some = np.diff(np.r_[new, len(hashes)]), np.flatnonzero(n)
                rows, ids = np.r_[row[new], some], batch.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(hashes[new].view(np.int64)), pa.nulls(len(some), pa.int64())]),
                        pa.array(key + rows),
                        pa.concat_arrays([pa.nulls(len(new), pa.int64()), ids.take(pa.array(some))]),
                        pa.array(np.r_[tf, np.zeros(len(some), np.int64)]),
                        pa.array(n[rows]),
                    ],
                    ["term", "key", "doc_id", "tf", "n"],
                )
                key += batch.num_rows

    return docs.select("doc_id", "text").mapInArrow(run, "term bigint, key bigint, doc_id bigint, tf bigint, n bigint")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best(df: DataFrame, k: int, *order: F.Column, by: str = "item") -> DataFrame:
    """The first k rows of each group, with their `rank`; tasks cut their rows to k a group before these meet."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def thresholds(item: np.ndarray, most: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query the largest uniform threshold T (at least 0) at which unfetched postings cannot add up to its bound.

    `item` is the query of each list, sorted from 0, and `most` the largest contribution of the
    list. Postings below T contribute at most min(T - 1, most) each; their sum stays below the bound.
    """
    low, high = np.zeros(len(bound), np.int64), np.maximum(bound, 0)
    while (low < high).any():
        mid = low + (high - low + 1) // 2
        total = np.zeros(len(bound), np.int64)
        np.add.at(total, item, np.minimum(mid[item] - 1, most))
        good = total < bound
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    return low


def _sums(fetched: DataFrame, item: np.ndarray, term: np.ndarray, weight: np.ndarray, most: np.ndarray, least: np.ndarray, low: np.ndarray, first: int | None = None) -> DataFrame:
    """(item, key, known, upper) of the documents that can reach their query's `low`, by blocks of documents.

    `known` is the sum of what was fetched, `upper` that and the most that the rest could add. With
    `first`, instead the documents of each block that are known to lie above `low`, that many with
    the highest sums at most: the k-th of all blocks together is a better bound.
    """
    shared = fetched.sparkSession.sparkContext.broadcast((item, term, weight, most, least, low))  # PASS_ROWS at most

    def run(rows: pa.Table) -> pa.Table:
        item, term, weight, most, least, low = shared.value
        keys, doc = np.unique(rows.column("key").to_numpy(), return_inverse=True)
        order = np.argsort(rows.column("term").to_numpy(), kind="stable")
        t, c, doc = rows.column("term").to_numpy()[order], rows.column("c").to_numpy()[order], doc[order]
        begin, end = np.searchsorted(t, term, "left"), np.searchsorted(t, term, "right")
        rest = np.minimum(np.maximum(least[item] - 1, 0), most)
        out: list[tuple] = []
        cuts = np.searchsorted(item, np.arange(len(low) + 1))
        for i in range(len(low)):
            known, upper = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for j in range(cuts[i], cuts[i + 1]):
                if begin[j] == end[j]:
                    continue
                part = weight[j] * c[begin[j] : end[j]]
                on = part >= max(least[i], 1)
                at = doc[begin[j] : end[j]][on]
                known[at] += part[on]
                upper[at] -= rest[j]
            upper += known + rest[cuts[i] : cuts[i + 1]].sum()
            if first is None:
                on = np.flatnonzero((known > 0) & (upper >= low[i]))
            else:
                on = np.flatnonzero(known > low[i])
                on = on[np.argpartition(known[on], -first)[-first:]] if len(on) > first else on
            if len(on):
                out.append((np.full(len(on), i), keys[on], known[on], upper[on]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("item", "key", "known", "upper"), columns, strict=True)})

    blocks = fetched.withColumn("block", F.shiftright("key", BLOCK_BITS))
    return blocks.groupBy("block").applyInArrow(run, "item bigint, key bigint, known bigint, upper bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each query, equal ones by doc_id.

    `docs` has doc_id and text; other columns are not read. Rows are ranked one by one: rows that
    repeat an id, or id and text, have a rank each; rows without id come last among equal scores.
    Null and empty texts have no terms, count for nothing and are never found; a query without
    terms finds nothing. Queries equal in id and text are one; others that share an id are ranked
    apart. Without documents or queries the result is empty. Texts are read whole; a task holds
    slices of 2 MB, or one longer text.
    """
    spark = docs.sparkSession
    asked = settled(query_terms(items, item_id, item_text))
    rows = asked.count()
    vocabulary = asked.select("term").distinct()
    few = rows <= PASS_ROWS
    terms = np.sort(np.array([r["term"] for r in vocabulary.collect()], np.int64).view(np.uint64)) if few else None  # PASS_ROWS at most
    raw = _written(postings(docs, terms), "postings")
    if not few:
        raw = raw.join(vocabulary, "term", "left_semi").unionByName(raw.filter("term IS NULL"))
    total = raw.filter("term IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).collect()[0]
    if not (rows and total["l"]):
        return spark.createDataFrame([], RESULT)
    n_docs, n_terms = total["n"], total["l"]
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = settled(raw.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).filter("w > 0"))
    share = F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {n_docs}L) div {n_terms}L))")
    shares = raw.filter("term IS NOT NULL").join(_small(weighed.select("term")), "term", "left_semi").select("term", "key", share.alias("c"))
    lists = _written(shares.repartitionByRange("term", F.desc("c"), "key").sortWithinPartitions("term", F.desc("c"), "key"), "lists")
    passes = -(-rows // PASS_ROWS)
    found = None
    for p in range(passes):
        own = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        one = _search(lists, own.join(_small(weighed), "term").select("item", "term", (F.col("w") * F.col("mult")).alias("w")), raw, k)
        found = one if found is None else found.unionByName(one)
    named = items.select(_item(item_id, item_text).alias("item"), F.col(item_id).cast("bigint").alias("item_id")).distinct()
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


def _search(lists: DataFrame, wanted: DataFrame, raw: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for the (item, term, w) rows of one pass."""
    wanted = settled(wanted)
    # heads: the first k postings of each list, and with them the largest share of each
    heads = settled(_best(lists.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi"), k, F.desc("c"), F.col("key"), by="term"))
    met = heads.join(F.broadcast(wanted), "term").withColumn("part", F.col("w") * F.col("c"))
    lower = _best(met.groupBy("item", "key").agg(F.sum("part").alias("known")), k, F.desc("known"), F.col("key")).groupBy("item").agg(F.min("known").alias("low"), F.count("*").alias("n"))
    lower = lower.select("item", F.when(F.col("n") == k, F.col("low")).otherwise(0).alias("bound"))
    given = met.filter("rank = 1").groupBy("item", "term", "w").agg(F.max("part").alias("most")).join(lower, "item").orderBy("item", "term").toArrow()
    ids, item = np.unique(given["item"].to_numpy(), return_inverse=True)
    term, w, most = (given[c].to_numpy() for c in ("term", "w", "most"))
    bound = given["bound"].to_numpy()[np.searchsorted(item, np.arange(len(ids)))] if len(ids) else np.zeros(0, np.int64)
    least = thresholds(item, most, bound)
    # one threshold for all lists of a query; a list is fetched as far as any query needs it
    spark = lists.sparkSession
    need = -(-np.maximum(least[item], 1) // w)
    cut = spark.createDataFrame(pa.table({"term": term, "need": need})).groupBy("term").agg(F.min("need").alias("need"))
    fetched = lists.join(F.broadcast(cut), "term").filter("c >= need").select("term", "key", "c")
    # a block alone knows too low a bound; of the sums above the first one, the k-th of all blocks is the next
    tops = _best(_sums(fetched, item, term, w, most, least, bound, k), k, F.desc("known"), F.col("key"))
    kth = tops.groupBy("item").agg(F.min("known").alias("low"), F.count("*").alias("n")).filter(F.col("n") == k).toArrow()  # a row a query
    low = bound.copy()
    low[kth["item"].to_numpy()] = kth["low"].to_numpy()
    left = settled(_sums(fetched, item, term, w, most, least, low).select("item", "key"))
    # exact scores of the candidates, from all of their postings in the query's lists
    names = spark.createDataFrame(pa.table({"item": np.arange(len(ids)), "query": ids}))
    left = left.join(F.broadcast(names), "item").select(F.col("query").alias("item"), "key")
    keys = _small(left.select("key").distinct())
    looked = lists.join(keys, "key", "left_semi").join(F.broadcast(wanted), "term").select("item", "key", (F.col("w") * F.col("c")).alias("part"))
    exact = looked.join(_small(left), ["item", "key"], "left_semi").groupBy("item", "key").agg(F.sum("part").alias("score"))
    of = raw.filter("term IS NULL").select("key", "doc_id").join(keys, "key", "left_semi")
    return _best(exact.join(of, "key"), k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("key")).select("item", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH q AS (SELECT item_id, t, count(*) AS mult FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n_docs),
c AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS c FROM p, s),
r AS (SELECT item_id, doc_id, CAST(sum(mult * w * c) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN c USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {K}
"""
