"""Spelling variant grouping (operator 11): dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point tells them
apart: exactly then their common prefix plus common suffix reach the length of
the longer word minus one.

1. ``counted`` counts the words of all texts: each task sums its own, the sums
   are shuffled. ``vocabulary`` keeps those long and frequent enough.
2. Two near words, the longer of m code points, share the first half of m - 1
   code points or the last half. So each word enters a tile for its first and
   its last half, for m its length and its length plus one (``tiles``).
3. ``matches`` writes the words of a tile into padded code-point matrices, one
   flush left and one flush right, and compares blocks of rows with blocks of
   rows: the first unequal column of either is the common prefix or suffix.
4. A tile of more than ``TILE`` words (a common beginning) is not compared but
   cut again: its words share their prefix or suffix for half of what is left.
   After as many rounds as a word can be halved, only one place of the word is
   open, so no tile is left that exceeds its alphabet. Nothing is dropped.
5. Per word, the tiles send the number of near words and the most frequent one;
   ``grouped`` follows these forms to the root by doubling.

A pair lies in one tile only: one of suffixes takes pairs whose prefix is too
short for the tile of prefixes beside it (``below``).

Tiles hold at most ``TILE`` words, tasks work on them one Arrow batch at a time,
and the doubling joins written tables, so nothing is collected.

Defined results: null text has no words; a null id counts as an empty id in the
hash; repeated rows count again; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.session import scratch_path, ship_package

#: Letters of a run, after A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS = "a-zÀ-ÿ"
SLIP = 199  # a run whose hash this divides loses a code point
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs so many times as often as the word.
RATIO = 5
#: Words of a tile that are compared all with all; must exceed the alphabet.
TILE = 256
#: Code points of texts worked on at a time, and compared pairs' code points.
SLAB = 1 << 20
CELLS = 1 << 22
#: Different words of a task between two partial counts.
HELD = 200_000

TILES = "tile long, m int, prefix int, suffix int, below int, word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about SLAB code points, cut between runs."""
    at = 0
    not_letter = re.compile(f"[^{LETTERS}]")
    while len(text) - at > SLAB:
        cut = not_letter.search(text, at + SLAB)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def words_of(doc_id: int | None, text: str) -> Counter[str]:
    """Words of a text with their counts, slips made."""
    runs: Counter[str] = Counter()
    # Upper-case letters of Latin-1 stay: bytes.lower changes A-Z alone.
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        runs.update(RUN.findall(piece))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[str] = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % SLIP == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
        if run:
            out[run] += n
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of every word in ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if text.is_valid:
                    for w, n in words_of(i, text.as_py()).items():
                        held[w] += n
                    if len(held) >= HELD:
                        yield flush()
        yield flush()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return counted(docs).filter((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def _cut(words: DataFrame) -> DataFrame:
    """The two tiles that follow from each row's (m, prefix, suffix, below): half
    of what is left of the word shared at the front, or at the back."""
    left = F.col("m") - 1 - F.col("prefix") - F.col("suffix")
    front = F.col("prefix") + F.ceil(left / 2).cast("int")
    back = F.col("suffix") + F.floor(left / 2).cast("int") + 1
    size = F.char_length("word")
    both = words.select(
        "word",
        "n",
        "m",
        F.explode(
            F.array(
                F.struct(front.alias("prefix"), F.col("suffix").alias("suffix"), F.col("below").alias("below")),
                F.struct(F.col("prefix").alias("prefix"), back.alias("suffix"), front.alias("below")),
            )
        ).alias("t"),
    ).select("word", "n", "m", "t.*")
    # A tile's words may not be shorter than what they share.
    fits = both.filter(F.col("prefix") + F.col("suffix") <= size)
    key = F.xxhash64(
        "m",
        "prefix",
        "suffix",
        "below",
        F.substring("word", F.lit(1), F.col("prefix")),
        F.substring("word", size - F.col("suffix") + 1, F.col("suffix")),
    )
    return fits.select(key.alias("tile"), "m", "prefix", "suffix", "below", "word", "n")


def tiles(words: DataFrame) -> DataFrame:
    """The first tiles of each word: as the longer word of a pair, or as one that
    is a code point shorter (or as long)."""
    size = F.char_length("word")
    starts = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    none = F.lit(0)
    return _cut(
        starts.select(
            "word", "n", "m", none.alias("prefix"), none.alias("suffix"), F.lit(2**31 - 1).alias("below")
        )
    )


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words flush left and flush right, padded, and the lengths."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    width = int(size.max())
    ends = np.cumsum(size)
    place = np.arange(len(points)) - np.repeat(ends - size, size)
    row = np.repeat(np.arange(len(words)), size)
    left = np.zeros((len(words), width), np.uint32)
    right = np.zeros((len(words), width), np.uint32)
    left[row, place] = points
    right[row, np.repeat(size, size) - 1 - place] = points
    return left, right, size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading columns of each row of ``a`` with each row of ``b``."""
    unequal = a[:, None, :] != b[None, :, :]
    first = unequal.argmax(axis=2)
    return np.where(unequal.any(axis=2), first, a.shape[1])


def matches(words: list[str], m: int, prefix: int, suffix: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of near words of one tile, the longer of m code points, that
    share ``prefix`` and ``suffix`` code points and less than ``below`` in front."""
    left, right, size = _matrices(words)
    step = max(1, math.isqrt(CELLS // left.shape[1]))
    for i in range(0, len(words), step):
        rows = slice(i, i + step)
        for j in range(i, len(words), step):
            columns = slice(j, j + step)
            shorter = np.minimum(size[rows, None], size[None, columns])
            longer = np.maximum(size[rows, None], size[None, columns])
            front = np.minimum(_common(left[rows], left[columns]), shorter)
            back = np.minimum(_common(right[rows], right[columns]), shorter)
            near = (front + back >= m - 1) & (longer == m) & (front >= prefix) & (back >= suffix) & (front < below)
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            ahead = a < b
            yield a[ahead], b[ahead]


def _near_of(words: list[str], n: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """(word, near words, count of the most frequent, that word) of one tile."""
    a = np.concatenate([p for p, _ in pairs])
    if not len(a):
        return []
    b = np.concatenate([p for _, p in pairs])
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    # Most frequent first, ties by the word, so the first of each word is the best.
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    order = np.lexsort((rank[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    many = np.diff(np.append(first, len(own)))
    return [(words[own[f]], int(k), int(n[other[f]]), words[other[f]]) for f, k in zip(first, many)]


def _compared(dealt: DataFrame) -> DataFrame:
    """NEAR rows of whole tiles, which lie side by side in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(tile: list[dict], out: list[tuple]) -> None:
            if len(tile) > 1:
                words = [r["word"] for r in tile]
                t = tile[0]
                pairs = list(matches(words, t["m"], t["prefix"], t["suffix"], t["below"]))
                out += _near_of(words, np.array([r["n"] for r in tile]), pairs)

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["word", "n_near", "best_n", "best"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if held and held[0]["tile"] != r["tile"]:
                    flush(held, out)
                    held = []
                held.append(r)
            yield table(out)
        out = []
        flush(held, out)
        yield table(out)

    return dealt.mapInArrow(run, NEAR)


def near(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n) that have
    near words. ``words`` is read several times: pass a written table."""
    spark = words.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "spelling")
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    level, found = tiles(words), []
    for nth in range(max(1, longest.bit_length() + 1)):
        level.write.parquet(f"{path}/tiles-{nth}")
        level = spark.read.schema(TILES).parquet(f"{path}/tiles-{nth}")
        sizes = level.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = level.join(sizes, "tile")
        # One open place: all words of the tile are near, and no more than letters.
        done = (F.col("size") <= tile) | (F.col("prefix") + F.col("suffix") == F.col("m") - 1)
        whole = sized.filter(done).drop("size")
        found.append(_compared(whole.repartition("tile").sortWithinPartitions("tile")))
        larger = sized.filter(~done).drop("size")
        if larger.isEmpty():
            break
        level = _cut(larger)
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")
    )


def grouped(words: DataFrame, tile: int = TILE, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n; a written table) with form, root, n_near and form_n."""
    spark = words.sparkSession
    path = scratch_path(spark, "spelling-forms")
    joined = words.join(near(words, tile), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")).alias("form"),
        F.when(takes, F.col("best_n")).alias("form_n"),
    ).write.parquet(f"{path}/forms")
    forms = spark.read.schema("word string, n long, n_near long, form string, form_n long").parquet(f"{path}/forms")
    # Counts grow by ``ratio`` with each step, so a path has few steps, and each
    # round doubles how far the steps reach.
    steps = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("form_n"), F.min("n")).first()
    longest = math.ceil(math.log(most[0] / max(1, most[1]), ratio)) if most[0] and ratio > 1 else 0
    for nth in range(longest.bit_length()):
        steps.write.parquet(f"{path}/steps-{nth}")
        steps = spark.read.schema("word string, root string").parquet(f"{path}/steps-{nth}")
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(steps, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n, form, root, n_near, form_n of the words of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "vocabulary")
    vocabulary(docs, min_length, min_count).write.parquet(path, mode="overwrite")
    return grouped(spark.read.schema("word string, n long").parquet(path))
