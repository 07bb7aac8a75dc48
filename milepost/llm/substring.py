"""Substring dedup (operator 3): relative Lempel-Ziv parsing.

Every window of ``WINDOW`` words has an anchor: the run of ``GRAM`` words in it
with the least hash (the leftmost, of equals). Anchor and place depend on the
window's words alone, so equal windows have equal anchors. The windows of one
anchor follow each other; the words they cover are a block. Blocks tile a
document, and all blocks of all documents are the reference.

1. ``blocks`` lists each document's blocks: anchor hash, hash of the block's
   words, first word, number of windows.
2. ``_shared`` indexes them: anchors that occur once start no repeat. A block
   whose words occur again refers to its first occurrence (least row, then any).
3. ``parse`` factors each document greedily from left to right: a factor begins
   at a block that occurs again and grows while the next block is also the next
   one of the same reference. Factors are stored with start, length and
   reference; each has at least ``WINDOW`` words and every window of it starts
   elsewhere too, so it is a duplicate span.
4. At factor boundaries a block's anchor occurs in other words, so a part of it
   may occur elsewhere. These blocks, and of equal blocks the first, are checked
   window by window: hashes of their windows are counted over all documents.
5. Words under a factor or a repeated window are removed.

So the result is that of counting every window, while what is shuffled per
document is one entry per block (about one for 14 words of fresh text), a few
boundary windows, and the text twice. Counts are summed before they are
shuffled. A row, or a window, that makes up more than a ``SHARE``-th of all is
known by a broadcast list (so of less than ``SHARE`` entries) and spread over
tasks. Nothing is collected. Hashes have 64 bits.

Defined results: null text has no words (n_words 0, the hash of an empty
text); a document of fewer than WINDOW words keeps all; repeated rows repeat
each other and lose all words if they have a window. Words are kept unchanged,
joined by one blank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.llm.words import mix, slices, window_hashes, word_hashes
from milepost.session import few_files, scratch_path, ship_package

WINDOW = 35
GRAM = 8
#: Rows or windows that hold more than such a share of all, and more than OFTEN
#: of them, are spread over SALTS tasks.
SHARE = 10_000
OFTEN = 1000
SALTS = 64

BLOCKS = "row long, anchors array<long>, blocks array<long>, starts array<int>, counts array<int>"
FACTORS = (
    "row long, starts array<int>, lengths array<int>, ref_rows array<long>, ref_starts array<int>, "
    "edge_starts array<int>, edge_counts array<int>, edge_known array<boolean>"
)


def _anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the blocks of one text: first window, number of windows, anchor hash."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = window_hashes(words, gram)
    span = window - gram + 1
    # Leftmost least gram of each window: minimum over (hash, place), by doubling.
    least, place = grams, np.arange(len(grams))
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = slice(0, len(least) - step), slice(step, len(least))
        take = least[right] < least[left]
        place = np.where(take, place[right], place[left])
        least = np.where(take, least[right], least[left])
        width += step
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return start, np.diff(np.append(start, n)), grams[place[start]]


def _block_hashes(words: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words under each block, from prefix sums of place-weighted words."""
    # A sum of word * weight(place) over the block, with weights that are powers,
    # told apart by dividing out the place of the first word.
    power = np.full(len(words) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])
    end = start + count + window - 1
    inverse = np.full(len(words) + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    return mix((sums[end] - sums[start]) * inverse[start] + count.astype(np.uint64))


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """The text (null: empty), a number for the row's content, and ``more`` columns."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, body.alias("__body"), F.xxhash64("doc_id", body).alias("__row"))


def _lists(*columns: list[np.ndarray], kinds: tuple[pa.DataType, ...]) -> list[pa.Array]:
    return [pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)]


def blocks(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """BLOCKS of every text with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__body"):
            words, first = word_hashes([t.encode("utf-8", "surrogatepass") for t in b.column("__body").to_pylist()])
            ids = b.column("__row").to_numpy()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i in np.flatnonzero(np.diff(first) >= window):
                own = words[first[i] : first[i + 1]]
                start, count, anchor = _anchors(own, window, gram)
                hashes = _block_hashes(own, start, count, window)
                for column, value in zip(out, (ids[i], anchor.view(np.int64), hashes.view(np.int64), start, count)):
                    column.append(value)
            lists = _lists(*out[1:], kinds=(pa.int64(), pa.int64(), pa.int32(), pa.int32()))
            names = ["row", "anchors", "blocks", "starts", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *lists], names=names)

    return rows.select("__row", "__body").mapInArrow(run, BLOCKS)


SHARED = "row long, anchor long, block long, start int, count int, edge boolean"


def _often(total: int) -> Column:
    """Whether a key with ``n`` rows has more than a SHARE-th of ``total``."""
    return F.col("n") > max(OFTEN, total // SHARE)


def _met(left: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``left`` joined with ``counted`` (keys, n, ...; a written table, n rows of
    ``left`` for each key). Frequent keys, less than SHARE, are broadcast, so that
    their rows needn't meet in a task."""
    frequent = F.broadcast(counted.filter(_often(total)))
    others = left.join(frequent.select(*keys), keys, "left_anti").join(counted.filter(~_often(total)), keys)
    return left.join(frequent, keys).unionByName(others)


def _shared(listed: DataFrame, path: str) -> DataFrame:
    """The blocks (SHARED) whose anchor occurs again; ``edge``: in other words, too."""
    spark = listed.sparkSession
    zipped = F.explode(F.arrays_zip("anchors", "blocks", "starts", "counts")).alias("b")
    each = listed.select("row", zipped).select(
        "row",
        F.col("b.anchors").alias("anchor"),
        F.col("b.blocks").alias("block"),
        F.col("b.starts").alias("start"),
        F.col("b.counts").alias("count"),
    )
    index = (
        each.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
        .filter("n > 1")
        .select("anchor", "n", (F.col("low") != F.col("high")).alias("edge"))
    )
    total = listed.agg(F.sum(F.size("anchors"))).first()[0] or 0
    few_files(index, total // 2).write.parquet(f"{path}/index")
    index = spark.read.schema("anchor long, n long, edge boolean").parquet(f"{path}/index")
    met = _met(each, index, ["anchor"], total).select("row", "anchor", "block", "start", "count", "edge")
    return few_files(met, total)


def parse(shared: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """FACTORS of every row with shared blocks (a written table): the greedy
    parse, and the blocks at its boundaries whose windows are to be checked;
    ``edge_known`` if these are known to occur again and only serve others."""
    total = shared.count()
    contents = shared.groupBy("anchor", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("ref_row"), F.min_by("start", "row").alias("ref_start")
    )
    few_files(contents, total).write.parquet(f"{path}/contents")
    kinds = "anchor long, block long, n long, ref_row long, ref_start int"
    contents = shared.sparkSession.read.schema(kinds).parquet(f"{path}/contents")
    marked = _met(shared, contents, ["anchor", "block"], total)
    mark = F.struct("start", "count", "edge", (F.col("n") > 1).alias("again"), "ref_row", "ref_start")
    rows = marked.groupBy("row").agg(F.array_sort(F.collect_set(mark)).alias("m"))  # as many as a text has blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            fields = ("start", "count", "edge", "again", "ref_row", "ref_start")
            lists = [b.column(c) for c in fields]
            offsets = lists[0].offsets.to_numpy()
            flat = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            for row, a, z in zip(b.column("row").to_numpy(), offsets[:-1], offsets[1:]):
                parts = _factors(row, window, *(v[a:z] for v in flat))
                for column, value in zip(out, parts):
                    column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            names = ["row", "starts", "lengths", "ref_rows", "ref_starts", "edge_starts", "edge_counts", "edge_known"]
            yield pa.RecordBatch.from_arrays([b.column("row"), *_lists(*out, kinds=kinds)], names=names)

    split = rows.select("row", *(F.col(f"m.{c}").alias(c) for c in ("start", "count", "edge", "again", "ref_row", "ref_start")))
    return few_files(split.mapInArrow(run, FACTORS), total)


def _factors(
    row: int,
    window: int,
    start: np.ndarray,
    count: np.ndarray,
    edge: np.ndarray,
    again: np.ndarray,
    ref_row: np.ndarray,
    ref_start: np.ndarray,
) -> tuple[np.ndarray, ...]:
    """One document's factors and boundary blocks, from its shared blocks in
    order. A factor takes a block in if it goes on where the last one ended,
    here and in the reference."""
    s, c, r, p = start[again], count[again], ref_row[again], ref_start[again]
    goes_on = (s[1:] == s[:-1] + c[:-1]) & (r[1:] == r[:-1]) & (p[1:] == p[:-1] + c[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(s) else np.empty(0, np.int64)
    last = np.append(first[1:], len(s)) - 1 if len(s) else first
    lengths = s[last] + c[last] + window - 1 - s[first]
    # Of equal blocks the one that others refer to is checked for them all.
    checked = edge & (~again | (ref_row == row) & (ref_start == start))
    return s[first], lengths, r[first], p[first], start[checked], count[checked], again[checked]


def _covered(begins: np.ndarray, lengths: np.ndarray, n_words: int) -> np.ndarray:
    """Words under the spans."""
    ends = np.zeros(n_words + 1, np.int64)
    np.add.at(ends, begins, 1)
    np.add.at(ends, begins + lengths, -1)
    return np.cumsum(ends[:-1]) > 0


def _windows(rows: DataFrame, factors: DataFrame, window: int) -> DataFrame:
    """(row, place, hash, known) of the windows of boundary blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__body"):
            words, first = word_hashes([t.encode("utf-8", "surrogatepass") for t in b.column("__body").to_pylist()])
            columns = [b.column(c).to_pylist() for c in ("__row", "edge_starts", "edge_counts", "edge_known")]
            out: tuple[list, ...] = ([], [], [], [])
            for i, (row, starts, counts, known) in enumerate(zip(*columns)):
                own = window_hashes(words[first[i] : first[i + 1]], window)
                for start, count, k in zip(starts, counts, known):
                    out[0].append(np.full(count, row, np.int64))
                    out[1].append(np.arange(start, start + count, dtype=np.int32))
                    out[2].append(own[start : start + count].view(np.int64))
                    out[3].append(np.full(count, k, bool))
            kinds = (np.int64, np.int32, np.int64, bool)
            arrays = [pa.array(np.concatenate([np.empty(0, k), *c])) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "place", "hash", "known"])

    edges = factors.filter(F.size("edge_starts") > 0).select(
        F.col("row").alias("__row"), "__salt", "edge_starts", "edge_counts", "edge_known"
    )
    wanted = rows.join(edges, ["__row", "__salt"]).select("__row", "__body", "edge_starts", "edge_counts", "edge_known")
    return wanted.mapInArrow(run, WINDOWS)


WINDOWS = "row long, place int, hash long, known boolean"


def _parsed(docs: DataFrame, rows: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a salt, and per (row, salt) its factors and repeated windows."""
    spark = docs.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "substring")

    def stored(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    listed = stored(blocks(rows, window, gram), "blocks", BLOCKS)
    shared = stored(_shared(listed, path), "shared", SHARED)
    factors = stored(parse(shared, path, window), "factors", FACTORS)

    # A row that repeats very often is spread: its factors go to every salt.
    copies = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    many = copies.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    many = many.filter(_often(docs.count()))
    many = stored(many.select("row", F.lit(True).alias("many")), "many", "row long, many boolean")
    salt = F.when(F.col("many"), F.floor(F.rand() * SALTS).cast("int")).otherwise(0)
    salted = rows.join(F.broadcast(many.withColumnRenamed("row", "__row")), "__row", "left").withColumn("__salt", salt)
    salts = F.when(F.col("many"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = factors.join(F.broadcast(many), "row", "left").withColumn("__salt", F.explode(salts)).drop("many")

    windows = stored(_windows(salted.drop("many"), spread, window), "windows", WINDOWS)
    # A repeated row lists its windows twice, which is right: they do occur twice.
    counts = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    n_windows = windows.count()
    counts = stored(few_files(counts, n_windows // 2), "counts", "hash long, n long")
    asked = windows.filter("not known").select("row", "place", "hash")
    repeated = _met(asked, counts, ["hash"], n_windows).groupBy("row").agg(F.collect_set("place").alias("places"))
    repeated = stored(few_files(repeated, n_windows), "repeated", "row long, places array<int>")

    decided = factors.select("row", "starts", "lengths").join(repeated, "row", "left")
    decided = decided.join(F.broadcast(many), "row", "left").withColumn("__salt", F.explode(salts))
    return salted.drop("many"), decided.select(F.col("row").alias("__row"), "__salt", "starts", "lengths", "places")


def _kept(docs: DataFrame, others: list[str], window: int, gram: int, as_it_is: bool) -> DataFrame:
    """``others`` of the columns, n_words, n_removed and the kept words; with
    ``as_it_is`` a text that loses nothing is returned unchanged."""
    rows, decided = _parsed(docs, _rows(docs, *(f"`{c}`" for c in others)), window, gram)
    both = rows.join(decided, ["__row", "__salt"], "left").select(
        *(f"`{c}`" for c in others), "__body", "starts", "lengths", "places"
    )
    counts = {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}
    schema = docs.select(*(f"`{c}`" for c in others)).withColumns(counts).schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__body"):
            columns = [b.column(c).to_pylist() for c in ("__body", "starts", "lengths", "places")]
            total, removed, kept = [], [], []
            for text, starts, lengths, places in zip(*columns):
                raw = text.encode("utf-8", "surrogatepass").split()
                under = np.zeros(len(raw), bool)
                if starts:
                    under |= _covered(np.array(starts), np.array(lengths), len(raw))
                if places:
                    under |= _covered(np.array(places), np.full(len(places), window), len(raw))
                gone = int(under.sum())
                total.append(len(raw))
                removed.append(gone)
                if gone:
                    raw = [w for w, u in zip(raw, under.tolist()) if not u]
                kept.append(text if as_it_is and not gone else b" ".join(raw).decode("utf-8", "surrogatepass"))
            new = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *new], names=schema.names)

    return both.mapInArrow(keep, schema)


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` plus n_words, n_removed and kept (the text without repeats), in
    place of columns that have these names."""
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    return _kept(docs, others, window, gram, as_it_is=False)


def removed(docs: DataFrame) -> DataFrame:
    """``docs`` without their repeated passages; same columns. A text that loses
    nothing stays as it is (null too); one that loses words keeps the others,
    joined by one blank, and ``n_chars``, where there is one, is its length."""
    # Each text travels once; the other columns, as one, beside it.
    others = F.struct(*(f"`{c}`" for c in docs.columns if c != "text"), F.col("text").isNull().alias("__null"))
    out = _kept(docs.select("doc_id", "text", others.alias("__others")), ["__others"], WINDOW, GRAM, as_it_is=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(~F.col("__others.__null"), F.col("kept"))}
    if "n_chars" in docs.columns:
        chars = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, chars).otherwise(F.col("__others.n_chars"))
    return out.select(*((new[c] if c in new else F.col(f"__others.`{c}`")).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document."""
    out = _kept(docs.select("doc_id", "text"), ["doc_id"], WINDOW, GRAM, as_it_is=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: list[str]) -> str:
    """The contract's hash of kept words, for tests."""
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()
