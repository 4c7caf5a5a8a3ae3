"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each source has a weight; the weights share out all words of the corpus as targets, and no
target passes a multiple of what its source holds. A source whose target passes its size is
first repeated in complete epochs; what is left of the target is a budget. Every document has
an exponential key, -ln(u) / w with u from a hash and w its quality weight: sorted by that key,
a source's documents are a weighted random order, and those whose running sum of words stays
within the budget are taken once more.

Built from DataFrame functions only. No source is ever sorted whole: the place where its budget
ends is searched by histograms of the key, each of which cuts the one bin that holds it into
bins again, until that bin has few rows; only these are sorted. So a source that holds most of
the corpus, or whose keys crowd together, costs no more than any other. The result is a few
thresholds per source, and each row decides for itself against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tutorlens.llm.tables import added, settled, table

#: Weights of the sources in order of their names, repeating, and the most that is taken of a document.
SHARES, MOST = (5, 2, 1), 3
#: Bins of a histogram, rows of a source that may be sorted together, and sources whose thresholds may be broadcast (about 10 MB).
BINS, SORTED_ROWS, BROADCAST_SOURCES = 1024, 4_096, 100_000
#: The words that a source's budget leaves are filled with documents of at most this part of them.
PART = 8
_SIZE, _KEY, _TIE = "__mix_size", "__mix_key", "__mix_tie"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def quality_weight(words: Column) -> Column:
    """A document's weight from its text: 0.1, plus up to 0.9 by the share of its words that are distinct."""
    return F.lit(0.1) + F.lit(0.9) * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """`docs` with `__mix_size` (words), `__mix_key` (the exponential key) and `__mix_tie`.

    Key and tie depend on seed, doc_id and text alone, so reruns agree and partitioning does
    not matter; only rows equal in both share them, and such rows are taken together. Texts are
    measured whole, however long.
    """
    w = docs.withColumn("__mix_words", _words(text)).withColumn(_TIE, F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)))
    u = (F.shiftrightunsigned(_TIE, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return w.withColumn(_SIZE, F.size("__mix_words").cast("bigint")).withColumn(_KEY, -F.log(u) / quality_weight(F.col("__mix_words"))).drop("__mix_words")


def targets(sizes: DataFrame, source: str = "source", shares: tuple[int, ...] = SHARES, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water is poured by weight, and full sources stop.

    Sources are few; they are ordered as strings, null last, for their weights. The ones that
    fill first come first in the order of size over weight, so one running pass finds all that
    stop, and what they leave is shared by weight among the rest.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    w = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(s)) for s in shares]), ((F.row_number().over(by_name) - 1) % len(shares)) + 1))
    w = w.withColumn("__cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col(source).isNull(), F.col(source))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    w = w.withColumn("__rank", F.row_number().over(order)).withColumn("__level", left / F.sum("__w").over(after))
    w = w.withColumn("__open", F.col("__cap") > F.col("__w") * F.col("__level"))
    first = F.min(F.when(F.col("__open"), F.struct("__rank", "__level"))).over(whole)
    w = w.withColumn("__first", first)
    open_ = F.col("__first").isNotNull() & (F.col("__rank") >= F.col("__first.__rank"))
    return w.select(source, "source_size", F.when(open_, F.col("__w") * F.col("__first.__level")).otherwise(F.col("__cap")).alias("target"))


def _small(df: DataFrame) -> DataFrame:
    """The per-source table, broadcast while it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def _of(rows: DataFrame, small: DataFrame, source: str, how: str = "inner") -> DataFrame:
    """`rows` with the columns of the per-source table, which calls its source __mix_source."""
    return rows.join(_small(small), F.col(source).eqNullSafe(F.col("__mix_source")), how)


def _last_within(rows: DataFrame, budgets: DataFrame, source: str) -> DataFrame:
    """(__mix_source, last, filled): the last (key, tie) in order up to which a source's sizes sum to its budget at most, and that sum.

    `rows` has source, size, key and tie; `budgets` has __mix_source and __mix_budget. Each round is
    one histogram over the rows of the bin that is still open: sums and counts only, combined on
    the map side, are shuffled. A source without an end has no row in the bin: all of it fits.
    """
    own = Window.partitionBy("__mix_source")
    open_ = budgets.select("__mix_source", "__mix_budget", F.lit(0).cast("bigint").alias("__mix_base"), F.lit(0.0).alias("__mix_lo"), F.lit(None).cast("double").alias("__mix_hi"))
    span = rows.groupBy(F.col(source).alias("__mix_from")).agg(F.min(_KEY).alias("__mix_least"), F.max(_KEY).alias("__mix_most"))
    open_ = open_.join(span, F.col("__mix_source").eqNullSafe(F.col("__mix_from"))).select("__mix_source", "__mix_budget", "__mix_base", F.col("__mix_least").alias("__mix_lo"), F.col("__mix_most").alias("__mix_hi"))
    open_, done = settled(open_), None
    while True:
        inside = _of(rows, open_, source).filter(F.col(_KEY).between(F.col("__mix_lo"), F.col("__mix_hi")))
        width = F.col("__mix_hi") - F.col("__mix_lo")
        place = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col(_KEY) - F.col("__mix_lo")) / width * BINS))).otherwise(0)
        bins = inside.groupBy("__mix_source", "__mix_budget", "__mix_base", place.alias("__mix_bin")).agg(F.sum(_SIZE).alias("__mix_n"), F.count("*").alias("__mix_rows"), F.min(_KEY).alias("__mix_lo"), F.max(_KEY).alias("__mix_hi"))
        upto = own.orderBy("__mix_bin")
        bins = bins.withColumn("__mix_end", F.col("__mix_base") + F.sum("__mix_n").over(upto))
        # the first bin that ends behind the budget; without one, the last
        over = F.min(F.when(F.col("__mix_end") > F.col("__mix_budget"), F.col("__mix_bin"))).over(own)
        bins = bins.withColumn("__mix_open", F.coalesce(over, F.max("__mix_bin").over(own))).filter("__mix_bin = __mix_open")
        found = settled(bins.select("__mix_source", "__mix_budget", (F.col("__mix_end") - F.col("__mix_n")).alias("__mix_base"), "__mix_lo", "__mix_hi", "__mix_rows"))
        few = (F.col("__mix_rows") <= SORTED_ROWS) | (F.col("__mix_lo") == F.col("__mix_hi"))
        ended = found.filter(few)
        done = ended if done is None else done.unionByName(ended)
        open_ = found.filter(~few).drop("__mix_rows")
        if open_.isEmpty():
            break
        open_ = settled(open_)
    edge = _of(rows, settled(done.drop("__mix_rows")), source).filter(F.col(_KEY).between(F.col("__mix_lo"), F.col("__mix_hi")))
    # rows equal in key and tie are one unit, so a row that repeats any number of times is one row here
    units = edge.groupBy("__mix_source", "__mix_budget", "__mix_base", _KEY, _TIE).agg(F.sum(_SIZE).alias("__mix_n"))
    units = units.withColumn("__mix_sum", F.col("__mix_base") + F.sum("__mix_n").over(own.orderBy(_KEY, _TIE))).withColumn("__mix_fits", F.col("__mix_sum") <= F.col("__mix_budget"))
    # where nothing of the bin fits, the order ends just before its first row
    first = F.struct(F.min(_KEY).alias(_KEY), F.lit(None).cast("bigint").alias(_TIE))
    last = F.max(F.when(F.col("__mix_fits"), F.struct(_KEY, _TIE)))
    out = units.groupBy("__mix_source").agg(F.coalesce(last, first).alias("last"), F.coalesce(F.max(F.when(F.col("__mix_fits"), F.col("__mix_sum"))), F.min("__mix_base")).alias("filled"))
    return settled(out)


def plan(rows: DataFrame, source: str = "source", shares: tuple[int, ...] = SHARES, most: int = MOST) -> DataFrame:
    """One row per source: source_size, target, epochs, and up to where documents are taken once more.

    `rows` needs the source and the columns of `measured`. Documents are taken in order up to
    `last` while their sum fits the budget. What is left is less than the document that follows;
    it is filled by later documents of at most an eighth of it, in order, up to `last2`, and by
    the one document of all others that comes nearest to what is left then, if that is nearer
    than leaving it. So a target is missed by little unless a source has few documents.
    """
    goal = targets(rows.groupBy(source).agg(F.sum(_SIZE).alias("source_size")), source, shares, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goal = goal.withColumnRenamed(source, "__mix_source").withColumn("__mix_budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = settled(goal)
    some = goal.filter("__mix_budget > 0").select("__mix_source", "__mix_budget")
    at = F.struct(_KEY, _TIE)
    first = _last_within(rows, some, source)
    gap = some.join(first.withColumnRenamed("__mix_source", "__mix_from"), F.col("__mix_source").eqNullSafe(F.col("__mix_from"))).select("__mix_source", "last", (F.col("__mix_budget") - F.col("filled")).alias("__mix_budget"), F.greatest(F.lit(1), F.floor((F.col("__mix_budget") - F.col("filled")) / PART)).alias("part"))
    gap = settled(gap)
    later = _of(rows, gap.drop("__mix_budget"), source).filter((at > F.col("last")) & (F.col(_SIZE) <= F.col("part")) & (F.col(_SIZE) > 0)).select(source, _SIZE, _KEY, _TIE)
    more = _last_within(later, gap.filter("__mix_budget >= 1").select("__mix_source", "__mix_budget"), source)
    more = more.select(F.col("__mix_source").alias("__mix_from"), F.col("last").alias("last2"), "filled")
    gap = gap.join(more, F.col("__mix_source").eqNullSafe(F.col("__mix_from")), "left").select("__mix_source", "last", "part", "last2", (F.col("__mix_budget") - F.coalesce("filled", F.lit(0))).alias("__mix_gap"))
    gap = settled(gap)
    open_ = _of(rows, gap, source).filter(~_once())
    miss = F.abs(F.col(_SIZE) - F.col("__mix_gap"))
    best = open_.filter(miss < F.col("__mix_gap")).groupBy("__mix_source").agg(F.min(F.struct(miss.alias("miss"), at.alias("at")))["at"].alias("extra"))
    best = best.withColumnRenamed("__mix_source", "__mix_from")
    thresholds = gap.drop("__mix_gap").join(best, F.col("__mix_source").eqNullSafe(F.col("__mix_from")), "left").drop("__mix_from").withColumnRenamed("__mix_source", "__mix_from")
    return settled(goal.drop("__mix_budget").join(thresholds, F.col("__mix_source").eqNullSafe(F.col("__mix_from")), "left").drop("__mix_from").select("__mix_source", F.struct("source_size", "target", "epochs", "last", "part", "last2", "extra").alias("__mix_plan")))


def _once(of: str = "", extra: bool = False) -> Column:
    """Whether a row lies within the thresholds of its source."""
    at, c = F.struct(_KEY, _TIE), lambda name: F.col(of + name)
    once = (at <= c("last")) | ((F.col(_SIZE) > 0) & (F.col(_SIZE) <= c("part")) & (at <= c("last2")))
    return F.coalesce(once | F.coalesce(at == c("extra"), F.lit(False)) if extra else once, F.lit(False))


def decide(rows: DataFrame, of: DataFrame, source: str = "source") -> DataFrame:
    """`rows` of `measured` with `__mix_size`, `__mix_copies`, and `__mix_plan`, a struct with the source's source_size and target."""
    met = _of(rows, of, source, "left")
    return met.withColumn("__mix_copies", F.col("__mix_plan.epochs") + _once("__mix_plan.", extra=True).cast("bigint")).drop("__mix_source", _KEY, _TIE)


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shares: tuple[int, ...] = SHARES, most: int = MOST, seed: int = 0) -> DataFrame:
    """Each row of `docs` with size, source_size, target, copies and taken (words, repeats counted); see `added` for clashing names."""
    size, whole, target, copies, taken = added(docs, "size", "source_size", "target", "copies", "taken")
    rows = settled(measured(docs, doc_id, text, seed))
    c, p = F.col("__mix_copies"), F.col("__mix_plan")
    out = decide(rows, plan(rows.select(F.col(source).alias("__mix_of"), _SIZE, _KEY, _TIE), "__mix_of", shares, most), source)
    return out.select(*docs.columns, F.col(_SIZE).alias(size), p["source_size"].alias(whole), p["target"].alias(target), c.alias(copies), (c * F.col(_SIZE)).alias(taken))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shares: tuple[int, ...] = SHARES, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mixture: each row of `docs` as often as it is taken, with the columns of `docs`, whatever their names.

    A null text has no words; rows without words count for no target and come along once when
    their source has a complete epoch or their key is within its budget. A null source is a
    source of its own. An empty table gives an empty mixture.
    """
    rows = measured(docs, doc_id, text, seed)
    of = plan(settled(rows.select(F.col(source).alias("__mix_of"), _SIZE, _KEY, _TIE)), "__mix_of", shares, most)
    return decide(rows, of, source).filter(F.col("__mix_copies") > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    p = F.col("__mix_plan")
    return decide(rows, plan(rows)).select("doc_id", F.col(_SIZE).alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), (F.col("__mix_copies") * F.col(_SIZE)).alias("taken"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets alone, which SQL can say too."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(_words("text"))).alias("source_size"))
    return targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


_COUNT = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
#: Water is poured in rounds: a round closes every source that the level overflows, at most one round a source.
TARGETS_ORACLE = f"""
WITH RECURSIVE s AS (SELECT source, sum({_COUNT}) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
r AS (
  SELECT 0 AS k, source, n, w, false AS full_, (SELECT sum(n) FROM s) / (SELECT sum(w) FROM w) AS level FROM w
  UNION ALL
  SELECT k + 1, source, n, w, f, (sum(n) OVER () - sum(CASE WHEN f THEN 3 * n ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN f THEN 0 ELSE w END) OVER (), 0)
  FROM (SELECT *, full_ OR w * level >= 3 * n AS f FROM r) WHERE k < (SELECT count(*) FROM s)
)
SELECT source, CAST(n AS BIGINT) AS source_size, round(CASE WHEN full_ THEN 3.0 * n ELSE w * level END, 3) AS target FROM r WHERE k = (SELECT count(*) FROM s)
"""
