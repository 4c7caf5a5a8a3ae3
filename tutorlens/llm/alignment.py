"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by an event sweep.

1. Every text is cut by both tokenizers. An event says that a token ends at a byte; the events of
   A and B go together into blocks of one side each, which hold token ids only, as an id tells
   its token's bytes and so the next end.
2. The blocks are dealt by document and sorted by offset within a partition. A machine reads
   them in that order; it holds the events that the other side has not caught up with, one block
   at most, and the open group. A byte where tokens of both sides end closes a group; between
   two neighbouring ends of either side exactly one A and one B token overlap, which is a link.
3. How many documents hold a linked pair of ids is counted with partial counts in tasks. Counts
   go back to the documents' pairs: those of the most frequent pairs, a bounded number, are
   broadcast, the others are joined by a shuffle.

Tokenizers have their ids in 16 bits.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.postings import narrow
from tutorlens.llm.tables import fresh_folder, settled, table
from tutorlens.llm.token_counts import _byte_letters

#: The byte-level tokenizer's pattern for pieces of a text.
PIECES_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of a text for B: no entry of its vocabulary goes on over a space behind another character, or has a line feed.
PIECES_B = r" +[^ \n]*|\n|[^ \n]+"
#: Texts with longer runs of one kind of characters go to the libraries whole.
LONG_RUN = 500
#: Events of a block, (id, id) pairs that are broadcast (13 bytes each), and pairs that a task gathers before it hands on their counts.
BLOCK, BROADCAST_PAIRS, GATHERED = 4096, 2_000_000, 1 << 21
EVENTS = "doc_id bigint, text_hash bigint, at bigint, side tinyint, ids binary"
SWEPT = "doc_id bigint, text_hash bigint, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


class Side(NamedTuple):
    """A tokenizer: the bytes of each id, and the ids of a text that begins with a space.

    `quick` cuts texts of characters below U+0100 by ranks of byte strings and gives numbers that
    `quick_ids` turns into ids; it is None where the vocabulary was not proven to allow that.
    Texts that hold `unless` are not cut so.
    """

    token_bytes: list[bytes]
    whole: Callable[[str], list[int]]
    quick: object | None
    quick_ids: np.ndarray
    unless: str | None

    def tokens(self, text: str) -> np.ndarray | None:
        """The ids of the text; None where the joined bytes of its tokens are not the text's."""
        if self.quick is not None and not (self.unless and self.unless in text) and is_plain(text):
            return self.quick_ids[self.quick.encode_ordinary(text)]
        ids = self.whole(text)
        return np.array(ids, np.uint16) if b"".join([self.token_bytes[i] for i in ids]) == text.encode() else None


def is_plain(text: str) -> bool:
    """Whether all characters are below U+0100, and no stretch of LONG_RUN of them is without white space or all white space."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    half = LONG_RUN // 2  # a longer run covers one of these stretches
    return all(_GAP.search(text, i, i + half) and _INK.search(text, i, i + half) for i in range(0, len(text) - half, half))


_GAP, _INK = re.compile(r"\s"), re.compile(r"\S")


def _ranked(name: str, pattern: str, entries: list[bytes]) -> object:
    import tiktoken

    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={b: rank for rank, b in enumerate(entries)}, special_tokens={})


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """The byte-level tokenizer at `path`.

    Where merges come in the order of the ids that they make and nothing is normalised, its ids
    are ranks: a pair of neighbours that joins to an entry is the pair that its merge names, as all
    earlier merges within the entry were made as if it stood alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    letters, names = _byte_letters(), tokenizer.get_vocab(with_added_tokens=True)
    known: list[bytes] = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        known[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    vocabulary, merges = raw["model"]["vocab"], raw["model"]["merges"]
    made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    proven = raw["normalizer"] is None and raw["pre_tokenizer"]["type"] == "ByteLevel" and raw["pre_tokenizer"]["use_regex"] and made == list(range(256, 256 + len(merges))) and len(vocabulary) == 256 + len(merges)
    quick = _ranked("a", PIECES_A, known[: len(vocabulary)]) if proven else None
    return Side(known, lambda text: tokenizer.encode(text, add_special_tokens=False).ids, quick, np.arange(len(known)).astype(np.uint16), None)


@functools.lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Side:
    """The sentence-piece tokenizer at `path`.

    It joins the neighbours that make the best entry first, as byte strings by rank do: first its
    single characters of two bytes, then its longer entries by score. That is proven where no entry
    crosses a place where texts are cut, every entry comes back as itself, and no scores are
    equal but those of runs of spaces, so texts with such runs are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    is_byte = [re.fullmatch("<0x[0-9A-F]{2}>", n) is not None for n in names]
    known = [bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, is_byte, strict=True)]
    entries = [i for i in range(len(names)) if not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    one = {known[i]: i for i in entries if len(names[i]) == 1}
    single = {known[i]: i for i in range(len(names)) if is_byte[i]} | {b: i for b, i in one.items() if len(b) == 1}
    longer = sorted((i for i in entries if len(names[i]) > 1), key=lambda i: -model.get_score(i))
    order = [single.get(bytes([b]), 0) for b in range(256)] + [i for b, i in one.items() if len(b) == 2] + longer
    inner = [names[i] for i in entries if "▁" in names[i].lstrip("▁") or "\n" in names[i]]
    # the library puts a space before what it is given
    alone = all(model.encode(names[i][1:].replace("▁", " ")) == [i] for i in entries if names[i].startswith("▁") and len(names[i]) > 1)
    scores = Counter(model.get_score(i) for i in longer)
    tied = [known[i] for i in longer if scores[model.get_score(i)] > 1]
    proven = len(single) == 256 and not inner and alone and not b"".join(tied).strip(b" ")
    quick = _ranked("b", PIECES_B, [bytes([b]) for b in range(256)] + [known[i] for i in order[256:]]) if proven else None
    return Side(known, lambda text: model.encode(text[1:]) if text else [], quick, np.array(order, np.uint16), "  " if tied else None)


@functools.lru_cache(maxsize=2)
def _lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(b) for b in side.token_bytes]) for side in (byte_level(path_a), sentence_pieces(path_b)))


@functools.lru_cache(maxsize=1)
def _strings() -> list[str]:
    """Every id with each separator before it."""
    return [f"{sep}{i}" for sep in ",|;" for i in range(1 << 16)]


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of the end events of both sides: (doc_id, text_hash, at, side, ids), `at` the byte where the first token begins.

    A document without tokens has one empty block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tutorlens.llm.words import slices

        sides, lengths = (byte_level(path_a), sentence_pieces(path_b)), _lengths(path_a, path_b)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                said = [" " + t if t else "" for t in batch.column("text").to_pylist()]
                row, at, of, ids = [], [], [], []
                for i, text in enumerate(said):
                    a, b = (side.tokens(text) for side in sides)
                    if a is None or b is None or not len(a):
                        row.append(i), at.append(0), of.append(0), ids.append(b"")
                        continue
                    for k, own in enumerate((a, b)):
                        ends = np.cumsum(lengths[k][own])
                        for j in range(0, len(own), BLOCK):
                            row.append(i), at.append(int(ends[j - 1]) if j else 0), of.append(k), ids.append(own[j : j + BLOCK].tobytes())
                where = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("text_hash").take(where), pa.array(at, pa.int64()), pa.array(of, pa.int8()), pa.array(ids, pa.binary())], ["doc_id", "text_hash", "at", "side", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, EVENTS)


class Sweep:
    """The state of one document: events that wait for the other side, the open group, and what was found."""

    def __init__(self, doc_id: int | None, text_hash: int):
        self.key = (doc_id, text_hash)
        self.copies, self.n, self.groups, self.links = 0, [0, 0], 0, 0
        self.seen: tuple[int, int] | None = None
        self.ends, self.ids = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.uint16)] * 2
        self.sha, self.pairs, self.held = hashlib.sha256(), [], 0

    def take(self, at: int, side: int, ids: bytes, lengths: tuple[np.ndarray, np.ndarray]) -> None:
        if (at, side) == (0, 0):
            self.copies += 1
        if (at, side) == self.seen or not ids:  # blocks of rows that are equal in id and text stand side by side
            return
        self.seen = at, side
        self.upto(at)
        own = np.frombuffer(ids, np.uint16)
        self.n[side] += len(own)
        self.ends[side] = np.concatenate([self.ends[side], at + np.cumsum(lengths[side][own])])
        self.ids[side] = np.concatenate([self.ids[side], own])

    def upto(self, at: int | None) -> None:
        """Closes the groups up to byte `at`, to which both sides are known; all of them where it is None."""
        (ea, eb), (ia, ib) = self.ends, self.ids
        if not len(ea) or not len(eb):
            return
        if at is not None:
            ea, eb = ea[: np.searchsorted(ea, at, "right")], eb[: np.searchsorted(eb, at, "right")]
        both = np.sort(np.concatenate([ea, eb]), kind="stable")
        twice = both[1:] == both[:-1]
        common = both[1:][twice]
        if not len(common):
            return
        na, nb = (int(np.searchsorted(e, common[-1], "right")) for e in (ea, eb))
        ea, eb, xa, xb = ea[:na], eb[:nb], ia[:na].astype(np.int64), ib[:nb].astype(np.int64)
        self.ends, self.ids = [self.ends[0][na:], self.ends[1][nb:]], [ia[na:], ib[nb:]]
        every = both[:-1][~twice]
        every = np.append(every[: np.searchsorted(every, common[-1])], common[-1])
        linked = np.sort((xa[np.searchsorted(ea, every)] << 16 | xb[np.searchsorted(eb, every)]).astype(np.uint32))
        new = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]]))
        self.pairs.append((linked[new], np.diff(new, append=len(linked))))
        self.held += len(new)
        if self.held > GATHERED:
            self.merge()
        # each group's A ids, then its B ids, with what stands before each
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        fa, fb = np.diff(ga, prepend=-1) > 0, np.diff(gb, prepend=-1) > 0
        codes = np.empty(na + nb, np.int64)
        codes[np.arange(na) + np.searchsorted(gb, ga)] = xa + np.where(fa, 2 << 16, 0)
        codes[np.arange(nb) + np.searchsorted(ga, gb, "right")] = xb + np.where(fb, 1 << 16, 0)
        said = "".join(map(_strings().__getitem__, codes.tolist()))
        self.sha.update((said if self.groups else said[1:]).encode())
        self.groups += len(common)
        self.links += len(every)

    def merge(self) -> None:
        """Keeps each distinct pair once."""
        pairs, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        self.pairs, self.held = [(pairs, np.bincount(at, np.concatenate([t for _, t in self.pairs])).astype(np.int64))], 0

    def result(self) -> tuple:
        self.upto(None)
        if not self.groups:
            return (*self.key, self.copies, 0, 0, 0, 0, "", b"", b"")
        if len(self.pairs) > 1:
            self.merge()
        pairs, times = self.pairs[0]
        return (*self.key, self.copies, *self.n, self.groups, self.links, self.sha.hexdigest(), np.diff(pairs, prepend=np.uint32(0)).tobytes(), narrow(times).tobytes())


def swept(blocks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document of the blocks: numbers of tokens, groups and links, the groups' digest, and its linked pairs.

    `pairs` are differences of sorted 32-bit numbers (A's id, then B's); `times` says how often each is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, now, out, held = _lengths(path_a, path_b), None, [], 0
        fields = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SWEPT.split(", ")]
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), fields, strict=True)], names)
        for batch in batches:
            for doc_id, text_hash, at, side, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "at", "side", "ids")), strict=True):
                if now is None or now.key != (doc_id, text_hash):
                    if now is not None:
                        out.append(now.result())
                        held += len(out[-1][8]) + 200
                    now = Sweep(doc_id, text_hash)
                    if held > 4 << 20:
                        yield rows(out)
                        out, held = [], 0
                now.take(at, side, ids, lengths)
        if now is not None:
            out.append(now.result())
        if out:
            yield rows(out)

    order = ("doc_id", "text_hash", "at", "side")
    return blocks.repartition("doc_id", "text_hash").sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def _unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    p = np.cumsum(np.frombuffer(pairs, np.uint32), dtype=np.uint32)
    return p, np.frombuffer(times, np.uint16 if len(times) == 2 * len(p) else np.uint32).astype(np.int64)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, size = [], [], 0
        for batch in batches:
            for own, copies in zip(batch.column("pairs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                pairs.append(np.cumsum(np.frombuffer(own, np.uint32), dtype=np.uint32))
                counts.append(np.full(len(pairs[-1]), copies))
                size += len(pairs[-1])
                if size >= GATHERED:
                    p, at = np.unique(np.concatenate(pairs), return_inverse=True)
                    pairs, counts, size = [p], [np.bincount(at, np.concatenate(counts)).astype(np.int64)], len(p)
                    if size >= GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(counts[0])], ["pair", "n"])
                        pairs, counts, size = [], [], 0
        if size:
            p, at = np.unique(np.concatenate(pairs), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(np.bincount(at, np.concatenate(counts)).astype(np.int64))], ["pair", "n"])

    n = settled(found.select("copies", "pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 16)
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # 65,536 rows at most
    return n.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of the texts behind one space.

    Null and empty texts, and those whose tokens' bytes are not the text's, have no tokens: zeros and
    an empty digest. Rows that repeat an id, or id and text, have a row each, and so have rows without
    id; an empty table gives an empty one. Other columns are not read. Texts are cut whole, in slices
    of 2 MB or one longer text; the sweep holds blocks of 4,096 tokens.
    """
    path = fresh_folder(docs.sparkSession, "alignment")
    swept(events(docs, path_a, path_b), path_a, path_b).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(SWEPT).parquet(path)
    counts = settled(pair_counts(found))
    sizes = {r["size"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}
    least, broadcast = max(sizes, default=0) + 1, 0
    while least > 0 and broadcast + sizes.get(least - 1, 0) <= BROADCAST_PAIRS:
        least -= 1
        broadcast += sizes.get(least, 0)
    frequent = counts.filter(F.col("n") >= 1 << least).orderBy("pair").toArrow() if broadcast else pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "best": pa.array([], pa.bool_())})
    known = docs.sparkSession.sparkContext.broadcast(tuple(frequent[c].to_numpy().astype(t) for c, t in (("pair", np.uint32), ("n", np.int64), ("best", bool))))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            sums, bests = [], []
            for own, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                p, t = _unpacked(own, times)
                at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
                on = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                sums.append(int((t[on] * n[at[on]]).sum())), bests.append(int(t[on][best[at[on]]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], [*batch.schema.names[:8], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = known.value[0]
        for batch in batches:
            for i, (own, times) in enumerate(zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True)):
                p, t = _unpacked(own, times)
                off = ~np.isin(p, pair)
                where = pa.array(np.full(int(off.sum()), i))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("text_hash").take(where), pa.array(p[off].astype(np.int64)), pa.array(t[off])], ["doc_id", "text_hash", "pair", "times"])

    out = found.mapInArrow(summed, SWEPT.partition(", pairs")[0] + ", n_best bigint, count_sum bigint")
    if least > 0:
        rows = found.mapInArrow(others, "o_id bigint, o_hash bigint, pair bigint, times bigint").join(counts, "pair")
        more = rows.groupBy("o_id", "o_hash").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
        same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash"))
        out = out.join(more, same, "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    each = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), *(public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
