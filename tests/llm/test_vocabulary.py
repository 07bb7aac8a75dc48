"""Operators 11 and 13 (words, phrases) against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from milepost.llm import collocations, spelling
from milepost.llm.registry import LLM_ORACLES, LLM_QUERIES
from tests.llm.helpers import documents, empty, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ------------------------------------------------------------------ operator 11
def brute_words(rows, min_length=6, min_count=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def brute_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(counts):
    near = {w: [x for x in counts if brute_near(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], root, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def groups(df):
    return sorted((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect())


def misspelt(rng, word):
    k = rng.randrange(len(word))
    letter = rng.choice("aeéÿx")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + letter + word[k + 1 :], word[:k] + letter + word[k:]])


def test_spelling_variants(spark):
    rng = random.Random(2)
    base = ["Straßen", "naïveté", "paragraph", "aaaaaaa", "letters", "abcdefÿ", "ABCDEF×G", "Éclairs"]
    texts = []
    for i in range(160):
        w = [b if rng.random() < 0.7 else misspelt(rng, b) for b in rng.choices(base, k=40)]
        texts.append((i, rng.choice([" ", "-", "3", "\n", "日"]).join(w)))
    # A chain of forms, each five times as frequent as the one before.
    texts += [(1000 + i, " ".join(["roottree"] * 35 + ["roottrex"] * 6)) for i in range(8)] + [(1100, "roottrxx " * 5)]
    texts += [(None, "roottrxx " * 3 + "nullidword " * 9), (5, None), (6, ""), (7, "x" * 5000 + " " + "x" * 4999), texts[0]]
    texts += [(2000 + i, "x" * 5000 + " " + "x" * 4999) for i in range(5)]
    docs = spark.createDataFrame([(i, t, 0, "w") for i, t in texts], "doc_id long, text string, n int, word string").repartition(4)
    want = brute_groups(brute_words(texts))
    assert any(f and f != r for _, _, f, r, _, _ in want)
    assert groups(spelling.variants(docs)) == want
    assert groups(spelling.variants(documents(spark))) == brute_groups(
        brute_words([(r.doc_id, r.text) for r in documents(spark).collect()])
    )
    assert spelling.variants(empty(spark)).count() == 0
    # Slabs cut between runs.
    text = " ".join(words(rng, 400, "ab", 9))
    whole = spelling.words_of(3, text)
    spelling.SLAB, before = 50, spelling.SLAB
    try:
        assert spelling.words_of(3, text) == whole
    finally:
        spelling.SLAB = before


@pytest.mark.parametrize("tile", [2, 5, 256])
def test_tiles_that_are_cut_again_lose_no_pair(spark, tmp_path, tile):
    """Words of two letters share beginnings and ends, so small tiles overflow."""
    rng = random.Random(tile)
    every = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(150)} | {"prefix" + c for c in "abcdefgh"}
    counts = {w: rng.choice([1, 2, 6, 40, 300]) for w in every}
    path = str(tmp_path / "words")
    spark.createDataFrame(sorted(counts.items()), "word string, n long").write.parquet(path)
    table = spark.read.parquet(path)
    assert groups(spelling.grouped(table, tile=tile)) == brute_groups(counts)


def test_common_lengths_tell_single_edits():
    rng = random.Random(8)
    some = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    for m in range(1, 8):
        tile = [w for w in some if len(w) in (m, m - 1)]
        if len(tile) < 2:
            continue
        spelling.CELLS, before = 9 * m, spelling.CELLS  # blocks of three rows
        try:
            pairs = {(tile[a], tile[b]) for i, j in spelling.matches(tile, m, 0, 0, 99) for a, b in zip(i, j)}
        finally:
            spelling.CELLS = before
        assert pairs == {
            (x, y) for k, x in enumerate(tile) for y in tile[k + 1 :] if brute_near(x, y) and max(len(x), len(y)) == m
        }


# ------------------------------------------------------------------ operator 13
def brute_phrases(rows, min_count, top=2000, longest=5):
    """rows: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < min_count:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang, w] = (a, left, right, n[lang], score)
    dropped = set()
    for (lang, w), (a, *_) in out.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if a >= out[lang, w[i : i + k]][0]:
                    dropped.add((lang, w[i : i + k]))
    result = []
    for lang in n:
        kept = [(-v[4], -v[0], " ".join(w).encode(), v) for (g, w), v in out.items() if g == lang and (lang, w) not in dropped]
        for rank, (_, _, phrase, v) in enumerate(sorted(kept)[:top], 1):
            result.append((lang, rank, phrase.decode(), *v))
    return sorted(result)


def phrases(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "B", "c", "dé", "日本", "x-y", "\x01", "\x00", "ß"]
    rows = []
    for _ in range(n):
        w = rng.choices(vocabulary, weights=[9, 8, 3, 5, 3, 2, 2, 1, 1, 1], k=rng.randint(0, 60))
        if rng.random() < 0.5:
            w += ["one", "fixed", "phrase", "of", "six", "words"] * rng.randint(1, 3)
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x85"]) for x in w)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("en", " .,\n "), rows[0], ("fr", "alone")]


@pytest.mark.parametrize(("min_count", "budget", "bits"), [(3, 200_000, 27), (10, 7, 27), (2, 3, 6)])
def test_collocations(spark, min_count, budget, bits):
    """Also with groups of few occurrences, so that prefixes are extended, and with a
    filter so small that it lets everything pass."""
    rows = corpus(min_count)
    df = spark.createDataFrame([(g, t, "z", 1) for g, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    want = brute_phrases(rows, min_count)
    assert len(want) > 20
    got = phrases(collocations.collocations(df, min_count=min_count, budget=budget, bits=bits))
    assert got == want
    few = phrases(collocations.collocations(df, min_count=min_count, top=3))
    assert few == brute_phrases(rows, min_count, top=3)


def test_collocations_of_edge_tables(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    docs = documents(spark)
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], 100)
    assert phrases(collocations.collocations(docs)) == want
    assert want  # "a a", "b a", ... of the repetitive texts


def test_long_texts_are_cut_without_losing_phrases(spark, monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcd") + rng.choice(["", "", "", "."]) for _ in range(4000))
    raw = text.encode()
    monkeypatch.setattr(collocations, "SLAB", 97)
    parts = list(collocations._cut(raw, 5))
    assert b"".join(p[:own] for p, own in parts) == raw and len(parts) > 50

    def suffix_counts(pieces):
        out = Counter()
        for p, own in pieces:
            begins, _, inside = collocations._grams(p, "en")
            w = p.translate(collocations._TO_BLANKS).split()
            assert len(w) == len(begins)
            for i in np.flatnonzero(begins < own):
                size = 1
                while size < 5 and inside[0][i + size - 1]:
                    size += 1
                out[b" ".join(w[i : i + size])] += 1
        return out

    assert suffix_counts(parts) == suffix_counts([(raw, len(raw))])


def test_best_phrases_of_shares_are_the_best(spark):
    rows = [("en" if i % 3 else "de", f"p {i % 50}", 100 + i % 7, 1, 1, 1, i % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long").distinct()
    one, many = collocations.ranked(df, 5, parts=1), collocations.ranked(df, 5, parts=17)

    def order(d):
        return [(r.lang, r["rank"], r.score, r.a) for r in d.orderBy("lang", "rank").collect()]

    assert order(one) == order(many) and len(order(one)) == 10


def test_exact_scores_beyond_64_bits(spark):
    big = 4_000_000_000
    p = spark.createDataFrame([("en", "x y", big)], "lang string, phrase string, n long")
    w = spark.createDataFrame([("en", "x", big + 1), ("en", "y", big + 3)], "lang string, word string, n long")
    row = collocations.scored(p, w).first()
    n = 2 * big + 4
    assert (row.n, row.score) == (n, 1000 * big * n // ((big + 1) * (big + 3)))


def test_collocations_match_their_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.sql(LLM_ORACLES["op13_collocations"])
    names = want.columns
    got = [tuple(r[c] for c in names) for r in LLM_QUERIES["op13_collocations"](spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(want.fetchall()) and got
