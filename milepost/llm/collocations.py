"""Phrase collocation mining (operator 13): vertical partitioning of suffixes.

Phrases of 2 to ``LONGEST`` words that occur often are counted as the nodes of a
suffix tree cut at that depth, which is built group by group as ERA (elastic
range) does, and scored by how much oftener they occur than their parts would by
chance.

1. ``word_counts`` counts all words of each language.
2. ``frequent_grams`` counts two and three neighbours by 64-bit hashes, summed in
   each task before they are shuffled. A hash counts at least what each of its
   grams does, so dropping the rare ones loses no frequent gram. The frequent ones
   set bits in a filter of ``FILTER_BITS`` bits: a fixed size, at every input.
3. ``leaves``: each word begins a suffix, which ends after ``LONGEST`` words, with
   its piece, or where the filter knows the next gram to be rare (no frequent
   phrase holds it). Equal suffixes of a task are one leaf, with its count. Leaves
   are dealt out by the words they begin with, in groups up to a budget of
   occurrences; too frequent prefixes are extended.
4. ``phrase_counts``: each group builds its subtree on its own, walking its leaves
   in order and keeping only the branch it is on; counts of nodes are totals of
   the leaves below. Nodes above extended prefixes get partial counts, which are
   summed.
5. ``scored`` looks up both parts of every cut of a phrase and scores it with exact
   decimals; ``maximal`` drops phrases that a longer one explains; ``ranked``.

The filter only spares work: where it is full, all suffixes are leaves. Words
and phrases are text in all counts that matter, so hashes decide nothing.

Defined results: null text is empty; a null ``lang`` counts as ``und`` (the same
language as rows that say so); words keep all but A-Z as they are; repeated rows
count again; an empty table gives an empty result; ``doc_id`` is not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from milepost.llm.words import mix, packed, run_hashes, unpacked
from milepost.session import scratch_path, ship_package

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Sizes of the neighbours that are counted by hash.
GRAMS = (2, 3)
#: Bits of the filter of frequent ones (16 MB as bits, 32 MB on their way).
FILTER_BITS = 27
#: Occurrences of a group's prefixes; a prefix is extended if it has more, and
#: more than a SHARE-th of all. So less than SHARE prefixes (8 MB) are broadcast.
BUDGET = 500_000
SHARE = 1 << 20
#: Bytes of text worked on at a time; words or suffixes, and hashes, held between partial counts.
SLAB = 1 << 20
HELD = 200_000
HELD_GRAMS = 1 << 21
#: Hashes of a range that one task sums.
DEALT = 1 << 21
#: The totals of so many languages are broadcast; more are joined by a shuffle.
LANGUAGES = 10_000
#: Phrases of a language that one task puts in order, beside the best of others.
ORDERED = 50_000

_BREAKS = b".,;:!?\n\v\f\r"
_BLANKS = b" \t"
_SEPARATOR = re.compile(rb"[ \t.,;:!?\n-\r]")
_TO_BLANKS = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def _cut(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts, each followed by the words that its last suffix
    needs; with the length of the part itself."""
    after = re.compile(rb"(?:[ \t.,;:!?\n-\r]*[^ \t.,;:!?\n-\r]+){0,%d}" % (longest - 1))
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + SLAB)
        end = cut.start() if cut else len(text)
        more = after.match(text, end).end() if cut else end
        yield text[at:more], end - at
        at = end


def _slabs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, bytes, int]]:
    """(language, lower-cased text, length without what follows it)."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, bytes, int]]:
        for lang, texts in held.items():
            joined = b"\n".join(texts)
            yield lang, joined, len(joined)
        held.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            raw = text.as_py().encode("utf-8", "surrogatepass").lower()  # A-Z alone
            if len(raw) > SLAB:
                for part, own in _cut(raw, longest):
                    yield lang, part, own
            else:
                held.setdefault(lang, []).append(raw)
                size += len(raw)
            if size >= SLAB:
                yield from flush()
                size = 0
    yield from flush()


def _grams(text: bytes, lang: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Places of the words; hashes of each word with the next one and the next
    two; and whether these stand in one piece."""
    raw = np.frombuffer(text + b"\n", np.uint8)
    breaks = np.isin(raw, np.frombuffer(_BREAKS, np.uint8))
    blank = breaks | np.isin(raw, np.frombuffer(_BLANKS, np.uint8))
    begins, words = run_hashes(raw, blank)
    piece = np.cumsum(breaks)[begins]
    own = np.uint64(int.from_bytes(lang.encode("utf-8", "surrogatepass")[-8:], "little"))
    hashes, inside = [], []
    gram = mix(words + mix(own[None]))
    for size in GRAMS:
        step = size - 1
        gram = mix(gram + _moved(words, step))
        hashes.append(gram)
        inside.append(np.arange(len(words)) < len(words) - step)
        inside[-1] &= _moved(piece, step) == piece
    return begins, hashes, inside


def _moved(values: np.ndarray, step: int) -> np.ndarray:
    """``values[i + step]`` at place i; zeros (false) past the end."""
    out = np.zeros_like(values)
    out[: max(0, len(values) - step)] = values[step:]
    return out


Batches = Iterator[pa.RecordBatch]
GRAM_ROWS = "gram long, n long, size int"


def _counting(docs: DataFrame, count: Callable[[Batches], Batches], schema: str) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")
    return rows.mapInArrow(count, schema)


def _held_rows(held: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        texts = pa.array(list(counts), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), texts, pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"],
        )
    held.clear()


def word_counts(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, word, n): occurrences of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}
        for lang, text, own in _slabs(batches, longest):
            held.setdefault(lang, Counter()).update(text[:own].translate(_TO_BLANKS).split())
            if sum(map(len, held.values())) >= HELD:
                yield from _held_rows(held)
        yield from _held_rows(held)

    parts = _counting(docs, count, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_grams(docs: DataFrame, total: int, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(gram, n, size): hashes of two and of three neighbours in one piece that
    occur ``min_count`` times or more. Each task deals its sorted hashes out by
    range, packed; ``total`` words decide how many ranges there are."""
    parts = max(1, -(-len(GRAMS) * total // DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {size: [] for size in GRAMS}

        def flush() -> Iterator[pa.RecordBatch]:
            for size, each in held.items():
                grams, n = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_counts=True)
                each.clear()
                part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
                ends = [*starts[1:], len(part)]
                columns = [
                    pa.array(part[starts].astype(np.int32)),
                    pa.array(np.full(len(starts), size, np.int32)),
                    pa.array([packed(grams[x:y]) for x, y in zip(starts, ends)], pa.binary()),
                    pa.array([n[x:y].astype(np.uint32).tobytes() for x, y in zip(starts, ends)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "size", "grams", "n"])

        for lang, text, own in _slabs(batches, longest):
            begins, hashes, inside = _grams(text, lang)
            for size, h, i in zip(GRAMS, hashes, inside):
                held[size].append(h[i & (begins < own)])
            if sum(map(len, held[GRAMS[0]])) >= HELD_GRAMS:
                yield from flush()
        yield from flush()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        grams = unpacked(table.column("grams").to_pylist())
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        sums = np.add.reduceat(n, starts)
        often = sums >= min_count
        columns = [pa.array(grams[starts][often].view(np.int64)), pa.array(sums[often])]
        size = pa.array(np.full(int(often.sum()), key[1].as_py(), np.int32))
        return pa.table([*columns, size], names=["gram", "n", "size"])

    dealt = _counting(docs, deal, "part int, size int, grams binary, n binary")
    return dealt.groupBy("part", "size").applyInArrow(add, GRAM_ROWS)


def gram_filter(frequent: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit set of the grams of ``frequent``: 2 ** bits bits, whatever the input."""
    places = frequent.select(F.shiftrightunsigned("gram", 64 - bits).alias("place"))
    set_bits = places.groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word")
    )
    out = np.zeros(1 << max(0, bits - 6), np.int64)
    rows = set_bits.toArrow()  # at most 2 ** (bits - 6) rows
    out[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return out.view(np.uint64)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``some``."""
    at = np.searchsorted(some, values)
    return (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == values) if len(some) else np.zeros(len(values), bool)


LEAVES = "lang string, group int, depth int, suffixes array<string>, n array<long>"


def leaves(
    docs: DataFrame, frequent: DataFrame, longest: int = LONGEST, bits: int = FILTER_BITS, budget: int = BUDGET
) -> DataFrame:
    """LEAVES: each task's suffixes and their counts, by groups of prefixes.
    ``frequent``: GRAM_ROWS, a written table.

    A word with its next one is a prefix; its frequency is known. Prefixes are
    dealt to so many groups that a group has about ``budget`` occurrences. Those
    that exceed it, and a SHARE-th of all, are extended by a word and dealt out by
    that, too: ``depth`` 3, for all their leaves.
    """
    spark = docs.sparkSession
    pairs = frequent.filter(F.col("size") == GRAMS[0])
    total = pairs.agg(F.sum("n")).first()[0] or 0
    groups = np.uint64(max(1, -(-total // budget)))
    # Less than SHARE rows.
    large = pairs.filter(F.col("n") > max(budget, total // SHARE)).select("gram").toArrow().column("gram")
    shared = spark.sparkContext.broadcast((gram_filter(frequent, bits), np.sort(large.to_numpy().view(np.uint64))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[tuple[int, int, bytes]]] = {}
        filtered, extended = shared.value

        def known(hashes: np.ndarray, inside: np.ndarray) -> np.ndarray:
            place = hashes >> np.uint64(64 - bits)
            return inside & ((filtered[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                rows: dict[tuple[int, int], tuple[list[bytes], list[int]]] = {}
                for (group, depth, suffix), n in counts.items():
                    row = rows.setdefault((group, depth), ([], []))
                    row[0].append(suffix)
                    row[1].append(n)
                columns = [
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array([g for g, _ in rows], pa.int32()),
                    pa.array([d for _, d in rows], pa.int32()),
                    pa.array([x for x, _ in rows.values()], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array([y for _, y in rows.values()], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "group", "depth", "suffixes", "n"])
            held.clear()

        for lang, text, own in _slabs(batches, longest):
            begins, hashes, inside = _grams(text, lang)
            pair, triple = (known(h, i) for h, i in zip(hashes, inside))
            more, on = pair.astype(np.int64), pair  # words that follow the first
            for step in range(longest - 2):
                on = on & _moved(triple, step)
                more += on
            start = np.flatnonzero(pair & (begins < own))
            words = text.translate(_TO_BLANKS).split()
            join = b" ".join
            suffix = [join(words[i : i + m + 1]) for i, m in zip(start.tolist(), more[start].tolist())]
            large = _among(hashes[0][start], extended)
            by = np.where(large & (more[start] > 1), hashes[1][start], hashes[0][start]) % groups
            counts = held.setdefault(lang, Counter())
            counts.update(zip(by.tolist(), np.where(large, 3, 2).tolist(), suffix))
            if sum(map(len, held.values())) >= HELD:
                yield from flush()
        yield from flush()

    return _counting(docs, deal, LEAVES)


def subtree(suffixes: Counter[tuple[str, ...]], depth: int, min_count: int) -> list[tuple[str, int]]:
    """Nodes of two words or more of the tree of ``suffixes`` (with their counts),
    by one walk over the leaves in order: a node is left when a leaf outside it
    comes, and its count is the total of the leaves below. Nodes above the
    group's prefixes (of ``depth`` words) are partial and all returned."""
    branch: list[str] = []
    totals: list[int] = []
    out: list[tuple[str, int]] = []

    def end(upto: int) -> None:
        while len(branch) > upto:
            n = totals.pop()
            if len(branch) > 1 and (n >= min_count or len(branch) < depth):
                out.append((" ".join(branch), n))
            branch.pop()
            if totals:
                totals[-1] += n

    for words in sorted(suffixes):
        same = 0
        for x, y in zip(branch, words):
            if x != y:
                break
            same += 1
        end(same)
        branch += words[same:]
        totals += [0] * (len(words) - same)
        totals[-1] += suffixes[words]
    end(0)
    return out


def phrase_counts(dealt: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, n) of the phrases that occur ``min_count`` times or more,
    from LEAVES: one subtree for each group."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, depth = (k.as_py() for k in key)
        counts: Counter[tuple[str, ...]] = Counter()
        for suffixes, n in zip(table.column("suffixes").to_pylist(), table.column("n").to_pylist()):
            for suffix, k in zip(suffixes, n):
                counts[tuple(suffix.split(" "))] += k
        found = subtree(counts, depth, min_count)
        columns = [pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string())]
        return pa.table([*columns, pa.array([n for _, n in found], pa.int64())], names=["lang", "phrase", "n"])

    trees = dealt.groupBy("lang", "group", "depth").applyInArrow(build, "lang string, phrase string, n long")
    return trees.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def scored(phrases: DataFrame, words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase by its weakest cut.
    ``phrases``: (lang, phrase, n), each at least ``min_count`` times; ``words``:
    (lang, word, n) of all words. Both are written tables."""
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    if sums.count() <= LANGUAGES:
        sums = F.broadcast(sums)
    words = words.filter(F.col("n") >= min_count)  # a phrase's words occur as often as it
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).unionAll(
        words.select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    )
    split = F.split("phrase", " ", -1)
    cuts = phrases.select(
        "lang",
        "phrase",
        F.col("n").alias("a"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(split) - 1),
                lambda k: F.struct(
                    F.array_join(F.slice(split, F.lit(1), k), " ").alias("first"),
                    F.array_join(F.slice(split, k + 1, F.size(split)), " ").alias("rest"),
                ),
            )
        ).alias("k", "cut"),
    ).select("lang", "phrase", "a", "k", "cut.*")
    first = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    rest = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    valued = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(sums, "lang")
    exact = "cast(a as decimal(38, 0)) * 1000 * n div (cast(l as decimal(38, 0)) * r)"
    weakest = F.min(F.struct(F.col("score"), F.col("k"), F.col("l"), F.col("r")))
    return (
        valued.withColumn("score", F.expr(exact).cast("long"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(weakest.alias("w"))
        .select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    )


def maximal(phrases: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, a, ...) without those that lie in a longer one
    that occurs as often. One that does so in a much longer phrase does so in one
    longer by a word, too, so only these are looked at."""
    split = F.split("phrase", " ", -1)
    inner = (
        phrases.filter(F.size(split) > 2)
        .select(
            "lang",
            F.col("a").alias("longer"),
            F.explode(
                F.array(
                    F.array_join(F.slice(split, F.lit(1), F.size(split) - 1), " "),
                    F.array_join(F.slice(split, F.lit(2), F.size(split) - 1), " "),
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    return phrases.join(inner, ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    bits: int = FILTER_BITS,
    budget: int = BUDGET,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    spark = docs.sparkSession
    path = scratch_path(spark, "collocations")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    words = stored(word_counts(docs, longest), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = stored(frequent_grams(docs, total, min_count, longest), "grams")
    phrases = stored(phrase_counts(leaves(docs, frequent, longest, bits, budget), min_count), "phrases")
    return ranked(maximal(scored(phrases, words, min_count)), top, parts=1 + phrases.count() // ORDERED)


def ranked(phrases: DataFrame, top: int = TOP, parts: int = 1) -> DataFrame:
    """The first ``top`` phrases of each language: first of each of ``parts``
    shares of it, then of what is left."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order)))
    best = some.filter(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return (
        best.withColumn("rank", place)
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
