"""Language identification in two steps: the family first, then one-versus-one within it.

Features are hashed byte n-grams (1 to 4 bytes) of the lower-cased text, as shares of all its
n-grams. A linear support vector machine per family tells it from the others; within a family
one machine for each pair of languages votes. Weights come from a bounded sample of labelled
documents, at most about `sample` a language drawn by a hash of the id over all of them, and
every text is then scored whole, vectorised over Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.tables import added, table
from tutorlens.llm.words import mix, slices, utf8

#: Families of languages; any other language is a family of its own kind, "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
#: Hashed features, lengths of n-grams, and labelled documents a language that are learned from, about.
FEATURES, LENGTHS, SAMPLE = 1 << 13, (1, 2, 3, 4), 400
UND = "und"


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """The feature of the n-gram that begins at each byte."""
    n = len(data) - length + 1
    code = np.zeros(max(n, 0), np.uint64)
    for k in range(length):
        code = (code << np.uint64(8)) | data[k : k + n]
    return (mix(code + np.uint64(length << 40)) & np.uint64(FEATURES - 1)).astype(np.int32)


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(texts.fill_null("") if texts.null_count else texts))


def features(texts: pa.Array) -> np.ndarray:
    """Rows of n-gram shares, one for each text; for the training sample only."""
    data, offsets = _prepared(texts)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i in range(len(out)):
        row = data[offsets[i] : offsets[i + 1]]
        for n in LENGTHS:
            if len(row) >= n:
                out[i] += np.bincount(_grams(row, n), minlength=FEATURES)
    return out / np.maximum(out.sum(axis=1), 1)[:, None]


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, reg: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine for labels +1 and -1.

    Subgradient steps on the regularised hinge loss, both classes weighing the same, averaged
    over the second half. The offset is the weight of a constant feature.
    """
    rng = np.random.default_rng(seed)
    w, mean, b, mean_b, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1]), 0.0, 0.0, len(y)
    balance = {s: len(y) / max(1, 2 * int(np.sum(y == s))) for s in (1, -1)}
    for epoch in range(epochs):
        for i in rng.permutation(len(y)):
            t += 1
            step = 1 / (reg * t)
            wrong = y[i] * (x[i] @ w + b) < 1
            w *= np.float32(1 - 1 / t)
            b *= 1 - 1 / t
            if wrong:
                w += np.float32(step * balance[y[i]] * y[i]) * x[i]
                b += step * balance[y[i]] * y[i]
        if epoch >= epochs // 2:
            mean += w
            mean_b += b
    return mean / (epochs - epochs // 2), mean_b / (epochs - epochs // 2)


class Model:
    """Trained machines. `machines` are (kind, positive, negative, offset); column k of `weights` belongs to machine k."""

    def __init__(self, machines: list[tuple[str, str, str, float]], weights: np.ndarray, families: dict[str, list[str]]):
        self.machines, self.weights, self.families = machines, np.ascontiguousarray(weights.astype(np.float32)), families

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The margin of every machine on every text: the mean weight of the text's n-grams, and the offset."""
        data, offsets = _prepared(texts)
        n, total = len(offsets) - 1, np.zeros((len(offsets) - 1, len(self.machines)))
        if n == 0 or not self.machines:
            return total
        sizes = np.diff(offsets)
        grams = np.zeros(n, np.int64)
        for length in LENGTHS:
            code = _grams(data, length)
            # the n-grams of a row are those that end in it
            begin, end = np.minimum(offsets[:-1], len(code)), np.minimum(np.maximum(offsets[1:] - length + 1, offsets[:-1]), len(code))
            grams += end - begin
            for k in range(len(self.machines)):
                running = np.concatenate(([0.0], np.cumsum(self.weights[:, k][code], dtype=np.float64)))
                total[:, k] += running[end] - running[begin]
        total /= np.maximum(grams, 1)[:, None]
        total += np.array([m[3] for m in self.machines])
        total[sizes == 0] = 0
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and a score of 0 to 1 for every text: sigmoids of the margins of the machines that decided."""
        n = len(texts)
        names = [UND] * n
        score = np.zeros(n)
        letters = pc.match_substring_regex(texts, r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
        if not self.families:
            return names, score
        margin = self.margins(texts)
        sure = 1 / (1 + np.exp(-np.clip(2 * margin, -50, 50)))
        family_names = sorted(self.families)
        votes = np.zeros((n, len(family_names)))
        for k, (kind, a, _, _) in enumerate(self.machines):
            if kind == "family":
                votes[:, family_names.index(a)] = margin[:, k]
        family = votes.argmax(axis=1)
        trust = 1 / (1 + np.exp(-np.clip(2 * votes.max(axis=1), -50, 50))) if len(family_names) > 1 else np.ones(n)
        for f, name in enumerate(family_names):
            langs = self.families[name]
            won, weight = np.zeros((n, len(langs))), np.zeros((n, len(langs)))
            for k, (kind, a, b, _) in enumerate(self.machines):
                if kind == name:
                    i, j = langs.index(a), langs.index(b)
                    won[:, i] += sure[:, k] >= 0.5
                    won[:, j] += sure[:, k] < 0.5
                    weight[:, i] += sure[:, k]
                    weight[:, j] += 1 - sure[:, k]
            # votes first, sums of sigmoids between equal votes, then the order of names
            best = (won + weight / (len(langs) + 1)).argmax(axis=1)
            share = weight[np.arange(n), best] / (len(langs) - 1) if len(langs) > 1 else np.ones(n)
            for r in np.flatnonzero((family == f) & letters):
                names[r], score[r] = langs[best[r]], min(1.0, float(trust[r] * share[r]))
        return names, score


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, families: dict[str, tuple[str, ...]] | None = None) -> Model:
    """Learns from rows of `labelled` with a text and a language; others are passed over.

    The sample is bounded: each language gives each of its rows the chance sample / count, by
    a hash of the id, so about `sample` rows a language reach the driver, however many there are,
    and not their texts but their feature shares, made in tasks from whole texts: 6 bytes for each
    feature that occurs, 48 kB a row at most. Without any usable row the model knows no language
    and answers `und`.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return Model([], np.zeros((FEATURES, 0)), {})
    chance = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample / n))])
    u = F.pmod(F.xxhash64(F.lit("lid"), F.col(doc_id)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                for i in range(0, batch.num_rows, 64):
                    part = batch.slice(i, 64)
                    x = features(part.column(text))
                    at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                    yield pa.RecordBatch.from_arrays([part.column(lang), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], ["lang", "at", "share"])

    rows = known.filter(u < chance[F.col(lang)]).select(text, lang).mapInArrow(shares, "lang string, at binary, share binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["share"])))
    langs = sorted({r["lang"] for r in rows})
    of = {name: family for family, names in (families or FAMILIES).items() for name in names}
    grouped: dict[str, list[str]] = {}
    for name in langs:
        grouped.setdefault(of.get(name, "other"), []).append(name)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for own, r in zip(x, rows, strict=True):
        own[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["share"], np.float32)
    # rare n-grams are scaled up, and the mean row gets length 1; both are folded into the weights
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    scale /= np.mean(np.linalg.norm(x * scale, axis=1))
    x *= scale
    own = np.array([r["lang"] for r in rows])
    family = np.array([of.get(k, "other") for k in own])
    machines, weights = [], []
    for name in sorted(grouped) if len(grouped) > 1 else []:
        w, b = train_svm(x, np.where(family == name, 1, -1))
        machines.append(("family", name, "", b))
        weights.append(w * scale)
    for name, members in sorted(grouped.items()):
        for a, c in itertools.combinations(members, 2):
            mine = (own == a) | (own == c)
            w, b = train_svm(x[mine], np.where(own[mine] == a, 1, -1))
            machines.append((name, a, c, b))
            weights.append(w * scale)
    return Model(machines, np.stack(weights, axis=1) if weights else np.zeros((FEATURES, 0)), grouped)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score for every whole text, however long; see `added` for names that clash.

    A text that is null or has no letter is `und` with score 0. Only the text is looked at.
    Rows are kept one by one, repeated ones and null ids included; an empty table stays empty.
    """
    names = added(docs, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                said, score = model.predict(batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, {names[0]} string, {names[1]} double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.filter(~held_out()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
