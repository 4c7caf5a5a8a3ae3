"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts every word from the two words on either side; the sum
of the conditional log-probabilities scores a document. The output is factored: the network
predicts a word's class, and the class its word. Frequent words are classes of their own, the
rest are classed by the hash of their ending, and every word's share of its class is its own
count over the whole corpus. Counts stay a table: the most frequent words are broadcast, and
those of all others are joined to the documents by a shuffle, so scores do not depend on how
many are broadcast.

The network is trained in numpy inside Spark tasks. The epochs part the positions of all
documents among them, so each is masked and predicted once. Documents are dealt by a hash of id
and text into blocks of about BLOCK_TOKENS words and lie in a fixed order there; in each epoch
every block masks that epoch's positions, takes mini-batch steps from the current weights, and
hands back weights. These are averaged by the number of positions they learned from, piece by
piece and FAN blocks at a time, and go out again. So what is learned depends on the documents
alone and not on how they are partitioned. All documents are counted and trained on; only the
model, whose size is fixed by parameters, and the words that are broadcast pass through the driver.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.tables import settled, table
from tutorlens.llm.words import mix, slices, utf8

#: Words with a class of their own, classes by ending, words that may be broadcast besides, and the width of the hidden layer.
OWN, ENDINGS, VOCABULARY, HIDDEN = 63, 32, 150_000, 24
#: Places around the predicted word; class 0 stands for what lies outside the document.
WINDOW = (-2, -1, 1, 2)
#: Epochs, positions in a step, learning rate, pieces of the model.
EPOCHS, STEP, RATE, PIECES = 2, 256, 1.0, 8
#: Words of a block that learns by itself, about, and blocks whose weights are averaged at a time.
BLOCK_TOKENS, FAN = 2_000_000, 256
CLASSES = 1 + OWN + ENDINGS
#: Logarithms of counts are added as whole multiples of 1 / UNIT, so that their order does not matter.
UNIT = 1 << 30


def ending_class(word: str) -> int:
    """The class of a word without one of its own: by the CRC-32 of its last three characters."""
    return 1 + OWN + zlib.crc32(word[-3:].encode()) % ENDINGS


@dataclass
class Vocabulary:
    """`index` numbers the words broadcast; entry i has class `cls[i]` and log share `share[i]` of it.

    One entry per class by ending follows, for all other words: its share is that of a count of
    1, to which the logarithm of the word's count in `counts` (word, n) is added by a join.
    """

    index: dict[str, int]
    cls: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    counts: DataFrame | None = None
    raw: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None, "raw": {}}

    def entries(self, words: list[str]) -> np.ndarray:
        return self.coded([w.encode() for w in words])

    def coded(self, words: list[bytes]) -> np.ndarray:
        """The entries of words given as UTF-8."""
        if len(self.raw) < len(self.index):
            self.raw = {w.encode(): i for w, i in self.index.items()}
        known, n = self.raw.get, len(self.index) - 1 - OWN
        return np.array([i if (i := known(w)) is not None else n + ending_class(w.decode(errors="replace")) for w in words], np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts: lower-cased runs of characters other than space and the controls 9 to 13."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")
    # an outer generator has no filter on its array inferred, for which texts would be split twice
    return docs.select(F.explode_outer(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts every word of the corpus; the most frequent, about VOCABULARY of them at most, are broadcast.

    The cut is a count: a histogram of counts, a few hundred rows, says from which count on
    the words fit, so no sort of the whole vocabulary is needed. A word below it has at most
    about one in VOCABULARY of all words, so none is hot in the join.
    """
    counts = settled(word_counts(docs))
    scale = F.floor(F.log2("n") * 8).cast("int")
    hist = sorted(((r["b"], r["k"]) for r in counts.groupBy(scale.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    kept, cut = 0, None
    for b, k in hist:
        if kept + k > VOCABULARY:
            break
        kept, cut = kept + k, b
    top = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    inside = counts.filter(scale >= cut).collect() if cut is not None else []  # at most VOCABULARY words
    rows = sorted({*top, *((r["word"], r["n"]) for r in inside)}, key=lambda r: (-r[1], r[0]))
    ends = 1 + OWN + F.pmod(F.crc32(F.substring("word", -3, 3).cast("binary")), F.lit(ENDINGS))
    rest = {r["c"]: r["n"] for r in counts.filter(~F.col("word").isin([w for w, _ in top])).groupBy(ends.alias("c")).agg(F.sum("n").alias("n")).collect()}
    index = {w: i for i, (w, _) in enumerate(rows)}
    cls = np.array([1 + i if i < OWN else ending_class(w) for i, (w, _) in enumerate(rows)] + list(range(1 + OWN, CLASSES)), np.int32)
    total = np.zeros(CLASSES)
    total[1 : 1 + len(top)] = [n for _, n in top]
    total[1 + OWN :] = [rest.get(c, 0) + 1.0 for c in range(1 + OWN, CLASSES)]  # and 1 for words not counted
    mass = np.array([float(n) for _, n in rows] + [1.0] * ENDINGS)
    return Vocabulary(index, cls, np.log(mass / total[cls]), np.log((total + 1) / (total + 1).sum()).astype(np.float32), counts)


class Network:
    """Class tables for each place of the window, summed into a tanh layer, and a softmax over classes."""

    def __init__(self, prior: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.parts = [
            (rng.standard_normal((len(WINDOW), CLASSES, HIDDEN)) * 0.3).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            (rng.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(np.float32),
            prior.astype(np.float32).copy(),
        ]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        table_, bias, _, _ = self.parts
        h = table_[0][context[:, 0]]
        for k in range(1, len(WINDOW)):
            h += table_[k][context[:, k]]
        h += bias
        return np.tanh(h, out=h)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(class | context) for each row."""
        z = self.hidden(context) @ self.parts[2]
        z += self.parts[3]
        chosen = z[np.arange(len(z)), target]
        # tanh and the weights bound z well inside the range of exp
        return chosen - np.log(np.exp(z, out=z).sum(axis=1))

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on the mean loss of the rows."""
        table_, bias, out, prior = self.parts
        n = len(target)
        h = self.hidden(context)
        z = h @ out
        z += prior
        np.exp(z, out=z)  # tanh and the weights bound z well inside the range of exp
        z /= z.sum(axis=1, keepdims=True) * np.float32(n)
        z[np.arange(n), target] -= np.float32(1 / n)
        back = (z @ out.T) * (1 - h * h)
        out -= rate * (h.T @ z)
        prior -= rate * z.sum(axis=0)
        bias -= rate * back.sum(axis=0)
        # the gradients of one entry of the class tables are added up in the order of positions
        flat = (context + np.arange(len(WINDOW), dtype=np.int32) * CLASSES).ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        table_.reshape(-1, HIDDEN)[flat[first]] -= rate * np.add.reduceat(back[order // len(WINDOW)], first, axis=0)


def contexts(cls: np.ndarray, starts: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The classes around each position; 0 where the window leaves the document."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(cls))[at]
    out = np.zeros((len(place), len(WINDOW)), np.int32)
    for k, shift in enumerate(WINDOW):
        q = place + shift
        ok = (q >= 0) & (q < len(cls))
        ok[ok] &= row[q[ok]] == row[place[ok]]
        out[ok, k] = cls[q[ok]]
    return out


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each row's values, which depends on that row alone."""
    out, some = np.zeros(len(starts) - 1), np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), starts[some])
    return out


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, h, n_tokens, base, cls, tail) for each row of `docs`, each word looked up once.

    `base` sums the entries' log shares, `cls` has the words' classes as 16-bit numbers, and
    `tail` the words that are not broadcast, with spaces between. `row` numbers the rows, `h` is
    a hash of id and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # at most about VOCABULARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                # bytes split at space and the controls 9 to 13 only
                data, offsets = utf8(batch.column("text"))
                raw = data.tobytes()
                own = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                starts = np.concatenate(([0], np.cumsum([len(w) for w in own]))).astype(np.int64)
                entries = vocab.coded([w for words in own for w in words])
                cls, rare = vocab.cls[entries].astype(np.uint16), entries >= len(vocab.index)
                kinds = [cls[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                tail = [b" ".join(itertools.compress(w, rare[a : a + len(w)])).decode(errors="replace") for w, a in zip(own, starts[:-1], strict=True)]
                columns = [batch.column("row"), batch.column("doc_id"), batch.column("h"), pa.array(np.diff(starts), pa.int64()), pa.array(_row_sums(vocab.share[entries], starts), pa.float64()), pa.array(kinds, pa.binary()), pa.array(tail, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h", "n_tokens", "base", "cls", "tail"])

    # lower-cased by Spark, as they are counted
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("h"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    out = settled(rows.mapInArrow(run, "row bigint, doc_id bigint, h bigint, n_tokens bigint, base double, cls binary, tail string"))
    shared.unpersist()
    return out


def _classes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all words of an encoded batch and where each row's begin."""
    data, offsets = utf8(batch.column("cls"))
    return np.frombuffer(data, np.uint16).astype(np.int32), offsets // 2


def train(docs: DataFrame, vocab: Vocabulary, epochs: int = EPOCHS) -> Network:
    """The network after `epochs` rounds of local steps and averaging over all documents."""
    return learned(encode(docs, vocab), vocab.prior, epochs)


def masks(ids: np.ndarray, starts: np.ndarray, epoch: int, epochs: int) -> np.ndarray:
    """The positions that an epoch predicts, by a hash of id and place in the text: each position falls to one of the epochs."""
    sizes = np.diff(starts)
    place = np.arange(sizes.sum()) - np.repeat(starts[:-1], sizes)
    return np.flatnonzero(mix(np.repeat(mix(ids), sizes) + place.astype(np.uint64)) % np.uint64(epochs) == np.uint64(epoch))


class Learner:
    """One block's steps: positions come in any portions and are learned from STEP at a time."""

    def __init__(self, prior: np.ndarray, start: np.ndarray, rate: float):
        self.net, self.rate, self.seen = Network(prior).load(start), np.float32(rate), 0
        self.context, self.target = np.zeros((0, len(WINDOW)), np.int32), np.zeros(0, np.int32)

    def take(self, context: np.ndarray, target: np.ndarray, last: bool = False) -> None:
        self.seen += len(target)
        context, target = np.concatenate([self.context, context]), np.concatenate([self.target, target])
        whole = len(target) if last else len(target) // STEP * STEP
        for i in range(0, whole, STEP):
            self.net.learn(context[i : min(i + STEP, whole)], target[i : min(i + STEP, whole)], self.rate)
        self.context, self.target = context[whole:], target[whole:]

    def weights(self, block: int) -> Iterator[pa.RecordBatch]:
        self.take(self.context[:0], self.target[:0], last=True)
        if self.seen:
            pieces = np.array_split(self.net.flat().astype(np.float64), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([block] * PIECES, pa.int64()), pa.array([self.seen] * PIECES, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "block", "seen", "weights"])


WEIGHTS = "piece int, block bigint, seen bigint, weights binary"


def learned(encoded: DataFrame, prior: np.ndarray, epochs: int = EPOCHS) -> Network:
    """What `train` learns, from rows of `encode`."""
    net = Network(prior)
    words = encoded.agg(F.sum("n_tokens").alias("n")).collect()[0]["n"] or 0
    blocks = max(1, -(-words // BLOCK_TOKENS))
    rows = encoded.select(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"), "h", "doc_id", "cls")
    # a block is whole in one partition and in order, so a task reads it as a stream
    dealt = settled(rows.repartition(int(blocks), "block").sortWithinPartitions("block", "h", "doc_id", "cls")) if epochs else rows
    for epoch in range(epochs):
        start = net.flat()
        rate = RATE / (1 + epoch)

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, epoch: int = epoch, rate: float = rate) -> Iterator[pa.RecordBatch]:
            at, mine = None, None
            for whole in batches:
                for batch in slices(whole, "cls", 1 << 19):
                    of = batch.column("block").to_numpy()
                    for block in np.unique(of):
                        part = batch.filter(pa.array(of == block))
                        if block != at:
                            if mine:
                                yield from mine.weights(at)
                            at, mine = int(block), Learner(prior, start, rate)
                        cls, starts = _classes(part)
                        ids = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                        masked = masks(ids, starts, epoch, epochs)
                        mine.take(contexts(cls, starts, masked), cls[masked])
            if mine:
                yield from mine.weights(at)

        sums, left = dealt.mapInArrow(run, WEIGHTS), blocks
        while True:
            sums = sums.withColumn("block", F.floor(F.col("block") / FAN)).groupBy("piece", "block").applyInArrow(_average, WEIGHTS)
            left = -(-left // FAN)
            if left == 1:
                break
        got = {r["piece"]: np.frombuffer(r["weights"], np.float64) for r in sums.collect()}  # PIECES rows, the model
        if got:
            net = net.load(np.concatenate([got[k] for k in sorted(got)]))
    return net


def _average(rows: pa.Table) -> pa.Table:
    """The mean of some blocks' weights by positions seen, added in the order of the blocks."""
    rows = rows.sort_by("block")
    seen = rows.column("seen").to_numpy()
    total = sum(float(n) * np.frombuffer(w.as_buffer(), np.float64) for n, w in zip(seen, rows.column("weights"), strict=True))
    first = rows.column("piece")[0].as_py(), rows.column("block")[0].as_py()
    return pa.table({"piece": pa.array([first[0]], pa.int32()), "block": pa.array([first[1]], pa.int64()), "seen": pa.array([int(seen.sum())], pa.int64()), "weights": pa.array([(total / seen.sum()).tobytes()], pa.binary())})


def score(docs: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """(doc_id, n_tokens, pll): each whole text's words and the sum of their conditional log-probabilities."""
    return scored(encode(docs, vocab), vocab.counts, net)


def scored(encoded: DataFrame, counts: DataFrame, net: Network) -> DataFrame:
    """What `score` gives, from rows of `encode` and the counts (word, n) of all words."""
    prior, flat = net.parts[3], net.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(prior).load(flat)
        for whole in batches:
            for batch in slices(whole, "cls", 1 << 19):
                cls, starts = _classes(batch)
                logs = np.zeros(len(cls), np.float32)
                context = contexts(cls, starts)
                for i in range(0, len(cls), 1 << 14):
                    logs[i : i + (1 << 14)] = model.log_probability(context[i : i + (1 << 14)], cls[i : i + (1 << 14)])
                sums = _row_sums(logs, starts) + batch.column("base").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(sums, pa.float64())], ["row", "doc_id", "n_tokens", "pll"])

    known = encoded.select("row", "doc_id", "n_tokens", "base", "cls").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, pll double")
    rare = encoded.filter("tail <> ''").select("row", F.explode_outer(F.split("tail", " ")).alias("word"))
    logs = counts.select("word", F.round(F.log("n") * UNIT).cast("bigint").alias("log"))
    added = rare.join(logs, "word").groupBy("row").agg(F.sum("log").alias("more"))
    return known.join(added, "row", "left").select("doc_id", "n_tokens", (F.col("pll") + F.coalesce("more", F.lit(0)) / F.lit(float(UNIT))).alias("pll"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, pll, pll_per_token) for each row of `docs`, which has doc_id and text.

    Texts without words, null ones included, have 0 tokens, a pll of 0 and no mean. Rows without
    doc_id are scored like others, and repeated rows get equal scores; all of them count in
    training. Texts are read whole: tasks work on slices of a megabyte, or on one longer text
    alone. Scores do not depend on partitioning. Other columns are not read. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    vocab = vocabulary(docs)
    encoded = encode(docs, vocab)
    return scored(encoded, vocab.counts, learned(encoded, vocab.prior)).withColumn("pll_per_token", F.try_divide("pll", "n_tokens"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
