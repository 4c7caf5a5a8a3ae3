"""Token alignment, license scans and ranked search against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorlens.llm import alignment, lexical_search, license_scan

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


# alignment

TEXTS = [
    "The cat's whiskers twitch, don't they?", "  leading and   inner spaces  ", "tabs\tand\r\nlines\n\n end", "naïve Straße été 12½ ²³", "日本語の文章 と English", "emoji 👩‍👩‍👧 joined",
    "a literal ▁ mark", "<|endoftext|> and <s> </s> stay text", "\x00\x01 controls \x85\xa0 x", "x" * 3000, "<0x41> spelled", None, "", " ", "word " * 2500, "'re 's ''t !'ve", "ﬁ ligature Å",
]


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(rows):
    """The contract's columns from whole texts and the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    first, second = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def one(text):
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        of_a = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return None
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(of_a), ends(of_b)
        links = []
        for i in range(len(a)):
            low = ea[i - 1] if i else 0
            links += [(a[i], b[j]) for j in range(len(b)) if (eb[j - 1] if j else 0) < ea[i] and low < eb[j]] if len(a) < 400 else []
        if len(a) >= 400:  # the same, in one walk
            j = 0
            for i in range(len(a)):
                while True:
                    links.append((a[i], b[j]))
                    if eb[j] >= ea[i]:
                        j += eb[j] == ea[i]
                        break
                    j += 1
        groups, both = [], sorted(set(ea) & set(eb))
        for low, high in zip([0, *both], both):
            groups.append(",".join(str(x) for x, e in zip(a, ea) if low < e <= high) + "|" + ",".join(str(x) for x, e in zip(b, eb) if low < e <= high) if len(both) < 500 else "")
        if len(both) >= 500:
            groups, i, j = [], 0, 0
            for high in both:
                x, y = i, j
                while i < len(ea) and ea[i] <= high:
                    i += 1
                while j < len(eb) and eb[j] <= high:
                    j += 1
                groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    found = [(i, one(t)) for i, t in rows]
    n = Counter(p for _, r in found if r for p in set(r[3]))
    most = Counter()
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    zero = (0, 0, 0, 0, 0, 0, "")
    return sorted(((i, *(zero if r is None else (*r[:3], len(r[3]), sum(n[p] == most[p[0]] for p in r[3]), sum(n[p] for p in r[3]), r[4]))) for i, r in found), key=repr)


def align_rows():
    rng = random.Random(3)
    rows = list(enumerate(TEXTS))
    rows += [(100 + i, "".join(rng.choice("ab é\n'1▁ß.") for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    return rows + [(0, TEXTS[0]), (0, "another text under the same id"), (None, "no id"), (None, "no id"), (None, None), (7, TEXTS[7])]


@pytest.mark.parametrize("block,most", [(4096, 2_000_000), (3, 40), (5, 0)])
def test_alignment_is_that_of_the_libraries(spark, monkeypatch, block, most):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    rows = align_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("n_a", F.lit("a caller's")).repartition(3)
    got = [tuple(r) for r in alignment.align(docs, *paths()).collect()]
    assert sorted(got, key=repr) == aligned(rows)
    assert alignment.align(docs.limit(0), *paths()).count() == 0


def test_the_sweep_holds_a_block_of_each_side(monkeypatch):
    lengths = np.array([0, 1, 2, 3]), np.array([0, 2, 2, 2])
    sweep, ids = alignment.Sweep(1, 1), lambda *x: np.array(x, np.uint16).tobytes()
    for i in range(200):
        sweep.take(6 * i, 0, ids(3, 1, 2), lengths)
        sweep.take(6 * i, 1, ids(1, 2, 3), lengths)
        assert max(len(e) for e in sweep.ends) <= 6
    got = sweep.result()
    assert got[2:7] == (1, 600, 600, 400, 800)
    whole = alignment._unpacked(*got[8:10])
    few = alignment.Sweep(1, 1)
    monkeypatch.setattr(alignment, "GATHERED", 5)
    for i in range(200):
        few.take(6 * i, 0, ids(3, 1, 2), lengths)
        few.take(6 * i, 1, ids(1, 2, 3), lengths)
        assert sum(len(p) for p, _ in few.pairs) <= 8
    assert all(np.array_equal(x, y) for x, y in zip(whole, alignment._unpacked(*few.result()[8:10]))) and whole[1].sum() == 800
    assert got[7] == hashlib.sha256(";".join(["3,1|1,2", "2|3"] * 200).encode()).hexdigest()


# license scans


def by_expression(words, templates=license_scan.TEMPLATES):
    """(template, start, end): the longest match at each start, by a regular expression over the joined words."""
    joined, out = "".join(" " + w for w in words), []
    starts = [m.start() for m in re.finditer(" ", joined)]
    for t, template in enumerate(templates):
        pattern, last = re.compile(license_scan.pattern(license_scan.parsed(template.markup))), -1
        first = {w for w in words if w.encode() in license_scan.Automaton((template,)).begin([0])}
        for i, at in enumerate(starts):
            ends = [n for n, k in enumerate([*starts[i + 1 :], len(joined)], 1) if pattern.fullmatch(joined, at, k)] if words[i] in first else []
            if ends and i + max(ends) > last:
                last = i + max(ends)
                out.append((t, i, last))
    return sorted(out, key=lambda m: (m[1], m[0]))


def test_templates_become_automata():
    own = (
        license_scan.Template("p", "p", "a b a"),
        license_scan.Template("o", "o", "<<beginOptional>>x <<var;least=1;most=2>><<endOptional>> a <<var;least=0;most=2>> c"),
        license_scan.Template("n", "n", "b <<beginOptional>>c <<beginOptional>>a<<endOptional>> c<<endOptional>> b"),
    )
    machine, rng = license_scan.Automaton(own), random.Random(1)
    for _ in range(400):
        words = [rng.choice("abcx") for _ in range(rng.randrange(1, 14))]
        assert machine.matches([w.encode() for w in words]) == by_expression(words, own), words
    for broken in ("<<beginOptional>>a", "a<<endOptional>>", "<<var;most=3>> a", "a <<var;most=3>>", "<<beginOptional>>a<<endOptional>>", "a <<var;least=3;most=2>> b", "a <<odd>> b"):
        with pytest.raises(ValueError):
            license_scan.Automaton((license_scan.Template("x", "x", broken),))


MIT = re.sub(r"<<[^>]*Optional>>", "", license_scan.TEMPLATES[3].markup)
LICENSED = [
    "Released UNDER the MIT\nLicense. Under the mit-license", "cc_by.NC cc by nc CC BY-NC 4.0", "Apache License, Version 2.0; apache license version 20", None, "", "...", "mit",
    re.sub("<<var[^>]*>>", "some holder", MIT), re.sub("<<var[^>]*>>", "some holder", MIT).replace("without restriction", "with restriction"), "under the mit license " * 4000,
    "This work is licensed under the GNU General Public License, version 3", "licensed under the gnu general public license, as published by the free software foundation, either version 3",
    "SPDX-License-Identifier: Apache-2.0", "Éunder the MIT License", "under the MIT Licenseé",
]


def test_license_scan_finds_phrases_and_templates(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0], None, None, None), (None, LICENSED[1], None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in license_scan.op12_license_scan(spark, str(tmp_path)).collect())
    phrases, weight, want = [terms_of(t.markup) for t in license_scan.BASE], license_scan.weights(), Counter()
    for doc_id, text, *_ in rows:
        w = terms_of(text)
        base = [(i, k) for k, p in enumerate(phrases) for i in range(len(w)) if w[i : i + len(p)] == p]
        found = by_expression(w) if len(w) < 1000 else [(0, i, i + 4) for i, _ in base]
        named = lambda x: ",".join(sorted({license_scan.TEMPLATES[t].label for t in x}))
        at = [i for i, _ in base]
        want[doc_id, len(w), len(base), min(at, default=None), max(at, default=None), named(k for _, k in base), named(t for t, *_ in found), max((weight[t] for t, *_ in found), default=0.0)] += 1
    assert got == want
    labels = {r["doc_id"]: r["labels"] for r in license_scan.op12_license_scan(spark, str(tmp_path)).collect()}
    assert labels[7] == "mit" and labels[8] == "" and labels[10] == labels[11] == "gpl-3" and labels[12] == "apache-2" and labels[13] == labels[14] == ""


def test_license_matches_keep_a_callers_columns(spark):
    docs = spark.createDataFrame([(1, "under the mit license", 7)], "doc_id bigint, text string, n_words int")
    r = license_scan.license_matches(docs).collect()[0]
    assert r["n_words"] == 7 and r["n_words_"] == 4 and [tuple(m) for m in r["matches"]] == [(0, 0, 4)]
    assert license_scan.license_matches(docs.limit(0)).count() == 0


# ranked search


def ranked(docs, items, k=20):
    cut = [(i, terms_of(t)) for i, t in docs]
    some = [(i, w) for i, w in cut if w]
    n_docs, n_terms = len(some), sum(len(w) for _, w in some)
    tf = [(i, len(w), Counter(w)) for i, w in some]
    df = Counter(t for *_, c in tf for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, n, c in tf:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(seed=0, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "Common"]
    pick = lambda k: " ".join(rng.choice(vocab[: 1 + int(rng.random() ** 2 * len(vocab))]) for _ in range(k))
    items = [(i, pick(rng.choice([1, 4, 15, 40]))) for i in range(8)]
    docs = [(i, pick(rng.choice([1, 3, 20, 60])) + (" " + rng.choice(items)[1] if i % 6 == 0 else "")) for i in range(n)]
    docs += [(1000 + i, docs[6][1]) for i in range(30)] + [(5, "w1 w2"), (5, docs[6][1]), docs[12], docs[12], (None, docs[6][1]), (None, None), (2000, ""), (2001, "..."), (2002, pick(4000)), (2003, None)]
    return docs, items + [(3, items[3][1]), (3, "w1 w5 w5"), (50, None), (51, ""), (52, "nowhere"), (None, "w7 w8 w9"), (53, "common " * 3)]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 3}, {"PASS_ROWS": 40, "BLOCK_BITS": 3}])
def test_search_is_that_of_all_scores(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = searched()
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).withColumn("score", F.lit("a caller's")).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    for k in (20, 3):
        got = lexical_search.search(frame, asked, k).collect()
        assert sorted((tuple(r) for r in got), key=repr) == ranked(docs, items, k)


def test_blocks_give_few_documents_that_cannot_be_among_the_best(spark, monkeypatch):
    made, real = [], lexical_search._sums

    def counting(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(lexical_search, "_sums", counting)
    monkeypatch.setattr(lexical_search, "BLOCK_BITS", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([20, 60])))) for i in range(1500)]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(6)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).repartition(3)
    got = lexical_search.search(frame, spark.createDataFrame(items, "item_id bigint, text string"), 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == ranked(docs, items, 3)
    # 48 blocks give each query 3 sums; of the documents a fifth at most can still be among the best
    assert len(made) == 2 and made[0] <= 6 * 3 * 51 and made[1] <= 6 * 1500 / 5, made


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b", None, None, None)], DOCS), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items), (docs, items.withColumn("text", F.lit("zz")))):
        assert lexical_search.search(d, i).collect() == []


def test_thresholds_leave_nothing_that_could_reach_the_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        item = np.sort(rng.integers(0, 4, 12))
        item[:4] = range(4)
        item.sort()
        most, bound = rng.integers(1, 100, 12), rng.integers(0, 300, 4)
        t = lexical_search.thresholds(item, most, bound)
        total = lambda x: np.bincount(item, np.minimum(x[item] - 1, most), minlength=4)
        assert ((total(t) < bound) | (t == 0)).all() and ((total(t + 1) >= bound) | (t == bound)).all()
