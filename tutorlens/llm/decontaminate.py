"""Benchmark decontamination against a broadcast hash set of benchmark n-grams.

Built from DataFrame functions only. The windows of the benchmark form a set of 64-bit hashes,
which is broadcast while their number is below a stated bound and shuffled beyond it. Training
texts are cut into words in the JVM, all their windows are hashed in one pass, and the hashes
probe that set. A hash only proposes: the words of each proposed window are compared with those
of the benchmark's, and only windows that agree are hits. Hits, a small share of all windows, are
gathered by document; they go back to the texts by a broadcast while they are small, measured in
bytes, and by a shuffled join beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.tables import added, settled, table

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Benchmark windows whose hashes may be broadcast (12 bytes each, about 40 MB as a hash table), and bytes of gathered hits.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised_words(text: str) -> Column:
    """The words of a text: runs of digits, a-z (A-Z folded) and characters from U+0080 on; null has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    # lower() is the quick way, and folds no other letter where there is no other capital
    folded = F.when(body.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(body, UPPER, LOWER)).otherwise(F.lower(body))
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_count(text: str) -> Column:
    """The number of those words; folding does not change it."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))


def _hashes(words: Column, width: int) -> Column:
    """One hash for each run of `width` words, in order."""
    last = F.size(words) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _place(at: Column, n_words: Column, widths: list[int]) -> Column:
    """The (pos, width) of the window at index `at` of the hashes of all widths, one width after the other."""
    out, before = None, F.lit(0)
    for k in widths:
        upto = before + F.greatest(F.lit(0), n_words - k + 1)
        here = F.struct((at - before + 1).cast("int").alias("pos"), F.lit(k).alias("width"))
        out = F.when(at < upto, here) if out is None else out.when(at < upto, here)
        before = upto
    return out


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, width, hash, gram) for every distinct window of every item; items without words have none."""
    w = items.select(F.col(item_id).cast("string").alias("item"), normalised_words(text).alias("words")).filter(F.size("words") > 0)
    w = w.withColumn("width", F.least(F.size("words"), F.lit(window)))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.slice("words", i, F.col("width")))
    return w.select("item", "width", F.explode(runs).alias("run")).select("item", "width", F.xxhash64("run").alias("hash"), F.array_join("run", " ").alias("gram")).distinct()


def window_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(__dc_id, __dc_key, __dc_spans, __dc_items), one row for each document with hits, known by its id and a hash of its text.

    __dc_spans are (pos, width) of the windows hit, __dc_items the ids of the items that have them.
    """
    grams = settled(benchmark_windows(items, item_id, item_text, window))
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect())  # at most `window` values
    hashes = grams.select("hash").distinct()
    hashes = F.broadcast(hashes) if hashes.count() <= BROADCAST_WINDOWS else hashes
    base = docs.select(F.col(doc_id).alias("__dc_id"), F.xxhash64(text).alias("__dc_key"), normalised_words(text).alias("words"))
    every = F.concat(*[_hashes(F.col("words"), k) for k in widths]) if widths else F.array().cast("array<bigint>")
    # The hashes are a column of their own: words are cut out once, and only ids go along with each window. An outer
    # generator has no filter on the size of its array inferred, for which all of it would be computed a second time.
    hashed = base.select("__dc_id", "__dc_key", F.size("words").alias("n"), every.alias("hashes"))
    runs = hashed.select("__dc_id", "__dc_key", "n", F.posexplode_outer("hashes").alias("at", "hash"))
    place = _place(F.col("at"), F.col("n"), widths) if widths else F.lit(None).cast("struct<pos:int,width:int>")
    proposed = runs.join(hashes, "hash").select("__dc_id", "__dc_key", "hash", place.alias("w")).groupBy("__dc_id", "__dc_key").agg(F.collect_set(F.struct("w.pos", "w.width", "hash")).alias("__dc_met"))
    # only the texts with proposed windows are cut into words again, and only those windows are looked at
    proposed = settled(proposed)
    few = _met(docs, proposed.select("__dc_id", "__dc_key"), F.lit(32), doc_id, text, "left_semi")
    near = _met(few, proposed, F.size("__dc_met") * 48 + 64, doc_id, text, "inner").select("__dc_id", "__dc_key", "__dc_met", normalised_words(text).alias("words"))
    said = F.transform("__dc_met", lambda w: F.struct(w["pos"].alias("pos"), w["width"].alias("width"), w["hash"].alias("hash"), F.array_join(F.slice("words", w["pos"], w["width"]), " ").alias("gram")))
    # the words are a column below the generator, so that they are cut out once and not for every window
    met = near.select("__dc_id", "__dc_key", F.explode_outer(said).alias("w")).select("__dc_id", "__dc_key", "w.*")
    met = settled(met.join(grams.select("hash", "gram").distinct(), ["hash", "gram"], "left_semi"))
    of = ["__dc_id", "__dc_key"]
    spans = met.groupBy(*of).agg(F.collect_set(F.struct("pos", "width")).alias("__dc_spans"))
    # the items of a window are gathered first, and a set of items that many windows have goes to a document once
    sets = settled(grams.groupBy("hash", "gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.md5(F.array_join("items", "\x1f"))))
    of_sets = met.select(*of, "hash", "gram").distinct().join(sets.select("hash", "gram", "set"), ["hash", "gram"]).select(*of, "set").distinct()
    own = of_sets.join(sets.select("set", "items").dropDuplicates(["set"]), "set").groupBy(*of).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("__dc_items"))
    own = own.select(F.col("__dc_id").alias("__dc_i"), F.col("__dc_key").alias("__dc_k"), "__dc_items")
    return settled(spans.join(own, F.col("__dc_id").eqNullSafe(F.col("__dc_i")) & (F.col("__dc_key") == F.col("__dc_k"))).drop("__dc_i", "__dc_k"))


def _met(docs: DataFrame, found: DataFrame, size: Column, doc_id: str, text: str, how: str) -> DataFrame:
    """`docs` joined with rows of `found` by id and text; these are broadcast while the bytes that `size` says they take are few."""
    heavy = found.agg(F.sum(size.cast("bigint")).alias("n")).collect()[0]["n"] or 0
    keyed = docs.withColumn("__dc_of", F.xxhash64(text))
    same = keyed[doc_id].eqNullSafe(found["__dc_id"]) & (keyed["__dc_of"] == found["__dc_key"])
    return keyed.join(F.broadcast(found) if heavy <= BROADCAST_BYTES else found, same, how).drop("__dc_of")


def _marked(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` with __dc_spans and __dc_items, null where nothing is hit."""
    size = F.lit(64) + 16 * F.size("__dc_spans") + F.aggregate("__dc_items", F.lit(0), lambda n, i: n + 16 + F.octet_length(i))
    return _met(docs, found, size, doc_id, text, "left").drop("__dc_id", "__dc_key")


def benchmark_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with three more columns: n_words, spans and items; see `added` for names that clash.

    `spans` is an array of (pos, width): a benchmark window of `width` words starts at word `pos`
    (from 1) of the normalised words. `items` are the items with such windows. Both are null where
    nothing is hit. Rows are kept one by one: rows that share a doc_id but not the text stay apart,
    equal rows get equal results. Null and empty texts have no words; texts of any length are
    scanned whole. An empty benchmark hits nothing. Names that begin with __dc_ are reserved.
    """
    names = added(docs, "n_words", "spans", "items")
    marked = _marked(docs, window_hits(docs, items, doc_id, text, item_id, item_text, window), doc_id, text)
    return marked.select(*docs.columns, word_count(text).alias(names[0]), F.col("__dc_spans").alias(names[1]), F.col("__dc_items").alias(names[2]))


def hit_positions(spans: str = "spans") -> Column:
    """The distinct word positions that lie in any hit window; null where there are no hits."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda h: F.sequence(h["pos"], h["pos"] + h["width"] - 1))))


def n_hit(spans: str = "spans") -> Column:
    """How many words lie in hit windows."""
    return F.coalesce(F.size(hit_positions(spans)), F.lit(0)).cast("bigint")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` without benchmark text, with the columns of `docs`, whatever their names.

    remove="documents" drops every document with a hit; remove="spans" keeps it without the
    hit words and the separators that follow each of them. Documents without hits come back
    unchanged, null and empty texts included.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = window_hits(docs, items, doc_id, text, item_id, item_text, window)
    if remove == "documents":
        return _met(docs, found.select("__dc_id", "__dc_key"), F.lit(32), doc_id, text, "left_anti")
    hit = _marked(docs, found, doc_id, text)
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    gone = hit_positions("__dc_spans")
    kept = F.concat(lead, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(gone, i + 1)), ""))
    return hit.withColumn(text, F.when(F.col("__dc_spans").isNull(), F.col(text)).otherwise(kept)).select(docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = benchmark_hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return hit.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS width, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)
),
x AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM g) WHERE len(w) >= width)
),
h AS (SELECT x.doc_id, x.i, x.width, g.item FROM x JOIN g USING (gram, width)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
