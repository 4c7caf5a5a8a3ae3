"""Token counts with a whole-token shortcut.

The vocabulary is examined once per worker: every entry that ends a word is spelled out and
encoded alone, and those that come back as exactly one token are proven whole. In a text,
pre-tokens found among them count one without any merging; the library merges only the
remaining distinct pre-tokens, and a bounded memo keeps their counts.

The shortcut is taken for texts whose characters are all below U+0100, where the library's
normaliser is lower-casing and folding of white space only. All other texts, and texts that
hold the string of a special token, go to the library whole, so every count is the library's.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlens.llm.tables import added, table

#: The vocabulary's own pattern for pre-tokens and its mark for a word's end.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The classes of that pattern for lower-cased characters below U+0100.
_CLASSES = {r"\s": r"\t-\r \x85\xa0", r"\p{L}": r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe"}
PIECES = re.compile(functools.reduce(lambda p, c: p.replace(*c), _CLASSES.items(), PRE_TOKEN).replace("[[", "[").replace("]]", "]"))
#: Distinct pre-tokens remembered by one worker, the whole ones included.
MEMO = 500_000


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _loaded(path: str):
    """The tokenizer, the pre-tokens proven to be one token each, its special strings, and a memo."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    letters, spelled = _byte_letters(), []
    for entry in raw["model"]["vocab"]:
        word = entry.removesuffix(WORD_END)
        if entry.endswith(WORD_END) and word and all(c in letters for c in word):
            try:
                spelled.append(bytes(letters[c] for c in word).decode())
            except UnicodeDecodeError:
                continue
    whole = {w for w, e in zip(spelled, tokenizer.encode_batch(spelled, add_special_tokens=False), strict=True) if len(e.ids) == 1}
    special = [t["content"] for t in raw["added_tokens"]]
    return tokenizer, whole, special, dict.fromkeys(whole, 1)


def proven_whole(path: str) -> frozenset[str]:
    """The pre-tokens that the tokenizer at `path` encodes alone as one token."""
    return frozenset(_loaded(path)[1])


def count_texts(texts: list[str], path: str) -> list[int]:
    """The library's token count of each text, through the shortcut where it is exact."""
    tokenizer, whole, special, memo = _loaded(path)
    out, pieces_of, unknown = [0] * len(texts), {}, set()
    for i, text in enumerate(texts):
        if not (text.isascii() or max(text) < "\u0100") or any(s in text for s in special):
            out[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            pieces_of[i] = PIECES.findall(text.lower())
            unknown.update(p for p in set(pieces_of[i]) if p not in memo)
    if len(memo) + len(unknown) > MEMO:
        memo.clear()
        memo.update(dict.fromkeys(whole, 1))
        unknown = {p for own in pieces_of.values() for p in own if p not in memo}
    if unknown:
        memo.update(zip(unknown, (len(e.ids) for e in tokenizer.encode_batch_fast(list(unknown), add_special_tokens=False)), strict=True))
    for i, own in pieces_of.items():
        out[i] = sum(map(memo.__getitem__, own))
    return out


def token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", group_bytes: int = 1 << 21) -> DataFrame:
    """`docs` with one more column `out`: the tokens of the whole text.

    A null text counts as empty: 0 tokens. Repeated rows and any ids, null included, are kept
    row by row, an empty table stays empty. Nothing is shuffled. See `added` for a caller's column
    that already has the name `out`.
    """
    (out,) = added(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tutorlens.llm.words import slices

        for whole in batches:
            for batch in slices(whole, text, group_bytes):
                texts = batch.column(text).fill_null("").to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count_texts(texts, path), pa.int64())], [*batch.schema.names, out])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{names}, `{out}` bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
