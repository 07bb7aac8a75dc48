"""N-gram Jaccard join (operator 4): token-group matrix.

Two documents link when 100 * |A and B| >= 75 * |A or B| over their sets of
5-word shingles. Documents with equal sets are one class from the start.

1. Keys are exact (prefix filter). Shingles are counted over all data, one for
   each class, and every set is put in the order (count, shingle). A link's
   intersection holds at least 75 per cent of either set, so the first
   n - ceil(0.75 n) + 1 shingles of both share one: these are a set's keys, and
   no link is without a common key. Shingles of one class alone come first and
   fit nobody, so they are counted only.
2. Groups of similar documents: a document is compared
   with the NEAREST of its keys' pivots, those it shares most keys with;
   verified links make groups (connected components), so a large crowd of
   copies becomes a group with a few comparisons each.
3. What is left are keys that several groups share. Neighbourhoods (trees of
   documents and the pivot each meets most often) are cut into blocks of about
   BLOCK sets or TOKENS shingles. A set asks the blocks of its own
   neighbourhood and of those that it shares a key with, if they hold a member
   of a larger group. A block and a bounded lot of its questions meet in one
   task, which builds the rows of the token-group matrix: the union of the
   block's shingles, and of each PART members next in size. A row that holds
   fewer of the query's shingles than a link with its smallest set needs stays
   closed; in opened parts each member is compared with the query.
4. Such a task unites groups as it finds links and compares no two sets of one;
   its links join groups; components give the smallest doc_id.

No comparison drops anything by number: sketches (a byte of each of POOL
min-hashes) only spare comparisons with
pivots (a pair that they rule out is met again in step 3), sizes and unions rule
out pairs exactly; all others are compared by whole sets.
Pairs inside a group are never made. Every step writes its table under
spark.checkpoint.dir, in as many files as its rows need.

Defined results: null or empty text has no set, links with nothing and is its
own component; 1 to 4 words are one shingle; repeated rows are equal sets; a
null doc_id takes part, but names no component unless it is alone (null then).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from milepost.llm.words import mix, packed, slices, unpacked, window_hashes, word_hashes
from milepost.session import few_files, scratch_path, ship_package

SHINGLE = 5
NEEDED = 75  # per cent of the union
POOL = 160
SURE = 0.45
PART = 32
#: Sets of a block, and questions that meet it in one task; shingles of either.
BLOCK = 512
LOT = 1024
TOKENS = 1 << 20
#: Pivots that a document is compared with.
NEAREST = 4
SLAB = 1 << 20
#: Shingles that a task gathers before it deals them out; shingles and parts of a dealing on average, parts at least.
GATHERED = 1 << 20
DEALT = 1 << 21
PARTS = 512
#: Shingles of sets, and pairs compared by whole sets, that are worth a file of their own.
FILE_SHINGLES = 1 << 18
FILE_PAIRS = 1 << 12

_RANDOM = random.Random(20)
_SALTS = [np.uint32(_RANDOM.getrandbits(32)) for _ in range(POOL)]
_FACTORS = [np.uint32(_RANDOM.getrandbits(32) | 1) for _ in range(POOL)]

SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_id long"
SETS = "set_id long, n int, shingles binary, sketch binary"


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])  # lower(): A-Z only
    shingles = window_hashes(words, SHINGLE)
    out = []
    for a, z in zip(first[:-1], first[1:]):
        if z - a >= SHINGLE:
            out.append(np.unique(shingles[a : z - SHINGLE + 1]))
        elif z > a:
            out.append(window_hashes(words[a:z], int(z - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _set_id(s: np.ndarray) -> int:
    """A number for the whole set; 0 for the empty one."""
    if not len(s):
        return 0
    total = np.add.reduce(mix(s), keepdims=True) ^ mix(np.bitwise_xor.reduce(mix(s + np.uint64(1)), keepdims=True))
    return int(mix(total).view(np.int64)[0]) | 1


def _slabs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLAB:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """POOL min-hashes (rows) of each non-empty set (columns)."""
    flat = np.concatenate(sets)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((POOL, len(sets)), np.uint32)
    for i in range(POOL):
        v = (low ^ _SALTS[i]) * _FACTORS[i]
        v ^= v >> np.uint32(15)
        out[i] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), starts)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, set_id of every document."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for at, texts in _slabs(b.column("text").to_pylist()):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(texts)),
                        b.column("text_hash").slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_set_id(s) for s in sets], pa.int64()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_id"],
                )

    return narrow.mapInArrow(run, SIGNATURE)


def _kept_bits(total: int) -> int:
    """Bits of a shingle that travel: whole bytes, and ten bits more than it takes to
    number ``total`` shingles, so that few of different texts are equal."""
    return min(64, 8 * -(-(total.bit_length() + 10) // 8))


def _elements(s: np.ndarray, bits: int) -> np.ndarray:
    """As many numbers as the sorted set has, of ``bits`` bits each: shingles whose
    first bits are equal are told apart by their order, so sets have no fewer in common."""
    if bits == 64:
        return s
    cut = s >> np.uint64(64 - bits) << np.uint64(64 - bits)
    if not (cut[1:] == cut[:-1]).any():
        return cut
    starts = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
    runs = np.diff(np.concatenate([starts, [len(cut)]]))
    return cut + (np.arange(len(cut)) - np.repeat(starts, runs)).astype(np.uint64)


def _cuts(by: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of the parts that hold any of ``by`` (ascending), by its high half."""
    part = ((by >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(by) else np.empty(0, np.int64)
    for a, z in zip(starts, [*starts[1:], len(by)]):
        yield int(part[a]), int(a), int(z)


def prefix_keys(docs: DataFrame, parts: int, bits: int = 48) -> DataFrame:
    """(set_id, key, nth, shared) of at least the shingles among each set's first
    n - ceil(0.75 n) + 1 that other sets have too, in the order of (count, shingle):
    nth of the ``shared`` ones. The n - shared others come before them.
    """
    texts_only = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    homes = max(1, parts // 4)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # copies met by one task count once here

        def flush() -> pa.RecordBatch:
            ids = np.array(list(held), np.int64).view(np.uint64)
            tokens = np.concatenate(list(held.values()))
            owners = np.repeat(ids, [len(s) for s in held.values()])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            cuts = list(_cuts(tokens, parts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in cuts], pa.int32()),
                    pa.array([packed(tokens[a:z]) for _, a, z in cuts], pa.binary()),
                    pa.array([packed(owners[a:z]) for _, a, z in cuts], pa.binary()),
                ],
                names=["part", "tokens", "owners"],
            )

        size = 0
        for b in slices(batches, "text"):
            for _, texts in _slabs(b.column("text").to_pylist()):
                for s in shingle_sets(texts):
                    if len(s) and (name := _set_id(s)) not in held:
                        held[name] = _elements(s, bits)
                        size += len(s)
                if size >= GATHERED:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        tokens, owners = (unpacked(table.column(c).to_pylist()) for c in ("tokens", "owners"))
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])])
        tokens, owners = tokens[new], owners[new]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.diff(np.concatenate([starts, [len(tokens)]]))
        n = np.repeat(n, n).astype(np.uint64)
        several = n > 1
        tokens, owners, n = tokens[several], owners[several], n[several]
        order = np.argsort(owners, kind="stable")
        tokens, owners, n = tokens[order], owners[order], n[order]
        cuts = list(_cuts(owners, homes))
        columns = [pa.array([packed(x[a:z]) for _, a, z in cuts], pa.binary()) for x in (tokens, owners, n)]
        return pa.table([pa.array([k for k, _, _ in cuts], pa.int32()), *columns], names=["home", "tokens", "owners", "n"])

    def choose(table: pa.Table) -> pa.Table:
        tokens, owners, n = (unpacked(table.column(c).to_pylist()) for c in ("tokens", "owners", "n"))
        order = np.lexsort((tokens, n, owners))
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        shared = np.diff(np.concatenate([starts, [len(owners)]]))
        nth = np.arange(1, len(owners) + 1) - np.repeat(starts, shared)
        shared = np.repeat(shared, shared)
        some = nth <= _prefix(shared, shared)  # a set has as many shingles at least
        columns = (owners.view(np.int64), tokens.view(np.int64), nth.astype(np.int32), shared.astype(np.int32))
        return pa.table([pa.array(x[some]) for x in columns], names=["set_id", "key", "nth", "shared"])

    dealt = texts_only.mapInArrow(deal, "part int, tokens binary, owners binary")
    counted = dealt.groupBy("part").applyInArrow(count, "home int, tokens binary, owners binary, n binary")
    return counted.groupBy("home").applyInArrow(choose, "set_id long, key long, nth int, shared int")


def _prefix(shared, n):
    """How many of a set's shared shingles are keys, of ``n`` shingles in all."""
    return shared + 1 - (NEEDED * n + 99) // 100


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, n, shingles, sketch) of the wanted sets; ``wanted``: set_id, doc_id of one document that has it."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    named = wanted.select("set_id", F.col("doc_id").alias("__doc"))
    chosen = narrow.join(named, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = b.column("set_id").to_pylist()
            for at, texts in _slabs(b.column("text").to_pylist()):
                # Rows that repeat the id may have another text.
                got = [(ids[at + i], s) for i, s in enumerate(shingle_sets(texts)) if _set_id(s) == ids[at + i]]
                marks = (_min_hashes([s for _, s in got]) >> np.uint32(7)).astype(np.uint8).T if got else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in got], pa.int64()),
                        pa.array([len(s) for _, s in got], pa.int32()),
                        pa.array([s.tobytes() for _, s in got], pa.binary()),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=["set_id", "n", "shingles", "sketch"],
                )

    return chosen.mapInArrow(run, SETS)


def _with(pairs: DataFrame, sets: DataFrame, side: str, *columns: str) -> DataFrame:
    """``pairs`` plus the columns of the set that ``side`` names, as <side>_<column>."""
    renamed = sets.select(F.col("set_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
    return pairs.join(renamed, side)


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes allow and sketches don't rule out."""
    sized = _with(_with(pairs, sets, "a", "n", "sketch"), sets, "b", "n", "sketch")
    fits = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * NEEDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a_s, b_s = (
                np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, POOL) for c in ("a_sketch", "b_sketch")
            )
            near = pa.array((a_s == b_s).mean(axis=1) >= SURE)
            yield b.select(["a", "b"]).filter(near)

    return sized.filter(fits).select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    whole = _with(_with(pairs, sets, "a", "shingles"), sets, "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("a_shingles").to_pylist(), b.column("b_shingles").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= NEEDED * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return whole.select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, "a long, b long")


def components(spark: SparkSession, edges: DataFrame, base: str) -> DataFrame:
    """(set_id, group): the smallest set_id that links reach, for every set with a link.

    Each round takes the least label around a set and then that label's own
    label; the distance that labels travel doubles, so rounds are few.
    """
    edges = edges.filter("a <> b")
    n = 2 * edges.count()  # no table of a round has more rows
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    few_files(both, n).write.parquet(f"{base}/edges")
    both = spark.read.schema("a long, b long").parquet(f"{base}/edges")
    labels = both.groupBy(F.col("a").alias("set_id")).agg(F.least(F.col("set_id"), F.min("b")).alias("group"))
    schema, nth = "set_id long, group long", 0
    while True:
        few_files(labels, n).write.parquet(f"{base}/labels{nth}")
        labels = spark.read.schema(schema).parquet(f"{base}/labels{nth}")
        near = (
            both.join(labels.withColumnRenamed("set_id", "b"), "b")
            .groupBy(F.col("a").alias("set_id"))
            .agg(F.min("group").alias("near"))
        )
        new = labels.join(near, "set_id").select("set_id", F.least("group", "near").alias("group"))
        few_files(new, n).write.parquet(f"{base}/next{nth}")
        new = spark.read.schema(schema).parquet(f"{base}/next{nth}")
        jump = new.select(F.col("set_id").alias("group"), F.col("group").alias("further"))
        old = labels.select("set_id", F.col("group").alias("old"))
        jumped = new.join(jump, "group", "left").select("set_id", F.coalesce("further", "group").alias("group"))
        nth += 1
        changed = jumped.join(old, "set_id").filter("group <> old")
        if changed.isEmpty():
            return labels
        labels = jumped


def _several(keyed: DataFrame, of: str) -> DataFrame:
    """Rows whose key occurs with several values of the column ``of``."""
    ends = keyed.groupBy("key").agg(F.min(of).alias("low"), F.max(of).alias("high"))
    return keyed.join(ends.filter("low <> high").select("key"), "key")


def linked_classes(docs: DataFrame, signed: DataFrame, base: str) -> DataFrame:
    """(set_id, group) of the sets that link with others. ``signed``: ``signatures``, stored."""
    spark = docs.sparkSession
    classes = (
        signed.filter("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    )
    n_docs, total = signed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    few_files(classes, n_docs).write.parquet(f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")
    keys = prefix_keys(docs, max(PARTS, total // DEALT), _kept_bits(total))
    few_files(keys, total, FILE_SHINGLES).write.parquet(f"{base}/prefixes")
    prefixes = spark.read.schema("set_id long, key long, nth int, shared int").parquet(f"{base}/prefixes")
    each = prefixes.join(classes.select("set_id", "n"), "set_id")
    each = each.filter(F.expr(f"nth <= shared + 1 - ({NEEDED} * n + 99) div 100")).select("set_id", "key")
    pivots = each.groupBy("key").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last"))
    keyed = each.join(pivots.filter("pivot <> last"), "key").select("set_id", "key", "pivot")
    few_files(keyed, prefixes.count()).write.parquet(f"{base}/keyed")
    keyed = spark.read.parquet(f"{base}/keyed")
    n_keyed = keyed.count()

    # Whole sets are fetched once, for documents that a key proposes.
    sets = _sets(docs, classes.join(keyed.select("set_id").distinct(), "set_id").select("set_id", "doc_id"))
    few_files(sets.dropDuplicates(["set_id"]), total, FILE_SHINGLES).write.parquet(f"{base}/sets")
    sets = spark.read.schema(SETS).parquet(f"{base}/sets")
    # Of the pivots of its keys, a document is compared with those that it meets most often.
    # A document has a quarter of its shingles as proposals at most: one exchange serves count, window and join.
    proposed = keyed.filter("set_id <> pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
    counted = proposed.repartition("a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    often = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    nearest = counted.withColumn("nth", F.row_number().over(often)).filter(F.col("nth") <= NEAREST).drop("n")
    few_files(nearest, n_keyed).write.parquet(f"{base}/nearest")
    nearest = spark.read.schema("a long, b long, nth int").parquet(f"{base}/nearest")
    verified = _links(_likely(nearest.select("a", "b"), sets), sets)
    few_files(verified, nearest.count(), FILE_PAIRS).write.parquet(f"{base}/links")
    links = spark.read.schema("a long, b long").parquet(f"{base}/links")
    groups = components(spark, links, f"{base}/groups")
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    closest = nearest.filter("nth = 1").select("a", "b")
    areas = components(spark, links.unionByName(closest), f"{base}/areas").withColumnRenamed("group", "area")

    # Sets with a key that several groups share; a set without a link is its own group.
    named = keyed.select("set_id", "key").join(groups, "set_id", "left")
    named = named.withColumn("group", F.coalesce("group", "set_id"))
    shared = _several(named, "group").join(areas, "set_id", "left").join(sizes, "group", "left")
    shared = shared.select(
        "set_id", "key", "group", F.coalesce("size", F.lit(1)).cast("long").alias("size"),
        F.coalesce("area", "set_id").alias("area"),  # a pivot that nobody meets most often is an area of its own
    )
    few_files(shared, n_keyed).write.parquet(f"{base}/shared")
    shared = spark.read.schema("set_id long, key long, group long, size long, area long").parquet(f"{base}/shared")
    _asked(shared, groups, sizes, areas, sets, base)
    asked = spark.read.schema("a long, block long, lot int").parquet(f"{base}/asked")
    blocks = spark.read.schema(BLOCKS).parquet(f"{base}/blocks")
    _matrix_links(asked, blocks, sets).write.parquet(f"{base}/more_links")
    more = spark.read.schema("a long, b long").parquet(f"{base}/more_links")
    # These unite groups, so only groups are followed now; a set without a link
    # so far is a group of its name.
    united = components(spark, more, f"{base}/whole").select(F.col("set_id").alias("group"), F.col("group").alias("whole"))
    loose = united.join(groups.select("group").distinct(), "group", "left_anti").select(F.col("group").alias("set_id"), "group")
    every = groups.select("set_id", "group").unionByName(loose)
    return every.join(united, "group", "left").select("set_id", F.coalesce("whole", "group").alias("group"))


BLOCKS = "set_id long, n int, size long, group long, block long"


def _asked(shared: DataFrame, groups: DataFrame, sizes: DataFrame, areas: DataFrame, sets: DataFrame, base: str) -> None:
    """Write ``blocks`` (the sets of each block) and ``asked`` (a, block, lot): who asks
    which block, in lots that one task can hold."""
    spark = shared.sparkSession
    # Members of groups that share a key with others, and the sets that do so alone.
    inside = groups.join(shared.select("group").distinct(), "group").join(sizes, "group")
    alone = shared.filter("size = 1").select("set_id", "group", "size").distinct()
    members = inside.select("set_id", "group", "size").unionByName(alone).join(areas, "set_id", "left").join(sets.select("set_id", "n"), "set_id")
    # A group of some size has blocks of its own, so that its members needn't ask them.
    unit = F.when(F.col("size") >= PART, F.col("group"))
    members = members.withColumn("unit", F.coalesce(unit, F.lit(0))).withColumn("area", F.coalesce("area", "set_id"))
    cuts = members.groupBy("area", "unit").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / TOKENS)).alias("cuts")
    )
    cut = F.pmod(F.xxhash64("set_id"), F.col("cuts"))
    stored = members.join(cuts, ["area", "unit"]).select(
        "set_id", "n", "size", "group", "area", F.xxhash64("area", "unit", cut).alias("block")
    )
    few_files(stored, sets.count()).write.parquet(f"{base}/blocks")
    stored = spark.read.schema(BLOCKS + ", area long").parquet(f"{base}/blocks")

    at = F.struct("size", "group")
    blocks = stored.groupBy("area", "block").agg(F.max(at).alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
    own = shared.select(F.col("set_id").alias("a"), "area")
    far = _several(shared, "area")
    others = far.select("key", "area").distinct()
    far = far.select("key", F.col("set_id").alias("a"), F.col("area").alias("home")).join(others, "key")
    where = own.unionByName(far.filter("area <> home").select("a", "area")).distinct()
    who = stored.select(F.col("set_id").alias("a"), F.col("n").alias("a_n"), at.alias("of"))
    fits = (F.col("a_n") * 100 >= F.col("least") * NEEDED) & (F.col("most") * 100 >= F.col("a_n") * NEEDED)
    # Each pair of groups is looked at from its smaller group.
    asks = where.join(who, "a").join(blocks, "area").filter(fits & (F.col("of") < F.col("top"))).select("a", "a_n", "block")
    asks.write.parquet(f"{base}/asks")
    asks = spark.read.schema("a long, a_n int, block long").parquet(f"{base}/asks")
    lots = asks.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / LOT, F.sum("a_n") / TOKENS)).alias("lots"))
    lot = F.pmod(F.xxhash64("a", "block"), F.col("lots")).cast("int")
    asked = asks.join(lots, "block").select("a", "block", lot.alias("lot"))
    few_files(asked, asks.count()).write.parquet(f"{base}/asked")


def _common(query: np.ndarray, tokens: np.ndarray) -> int:
    """How many of the query's shingles are among the tokens (both sorted)."""
    at = np.minimum(np.searchsorted(tokens, query), len(tokens) - 1)
    return int((tokens[at] == query).sum())


class _United:
    """Groups that are known to be one, in one task."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def of(self, group: int) -> int:
        root = group
        while (up := self.above.get(root, root)) != root:
            root = up
        while (up := self.above.get(group, group)) != root:
            self.above[group], group = root, up
        return root

    def unite(self, a: int, b: int) -> None:
        self.above[self.of(a)] = self.of(b)


def _matrix_links(asked: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between groups, found by a block's questions and its members
    of larger groups. A link counts for its groups only, so a question is not
    compared with members of groups that the task has already united with its
    own, and a task returns less links than it meets groups."""
    who = blocks.select(F.col("set_id").alias("a"), F.col("size").alias("a_size"), F.col("group").alias("a_group"))
    named = sets.select(F.col("set_id").alias("a"), "shingles")
    left = asked.join(who, "a").join(named, "a").select("block", "lot", "a", "a_size", "a_group", "shingles")
    lots = asked.select(F.col("block").alias("in_block"), F.col("lot").alias("in_lot")).distinct()
    held = blocks.join(sets.select("set_id", F.col("shingles").alias("tokens")), "set_id")
    right = held.join(lots, F.col("block") == F.col("in_block")).select("in_block", "in_lot", "set_id", "size", "group", "tokens")

    def run(questions: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if questions.num_rows and members.num_rows:
            united = _United()
            sets = [np.frombuffer(x, np.uint64) for x in members.column("tokens").to_pylist()]
            ids, sizes, names = (members.column(c).to_pylist() for c in ("set_id", "size", "group"))
            order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
            parts = [order[i : i + PART] for i in range(0, len(order), PART)]
            groups = [{(sizes[i], names[i]) for i in part} for part in parts]
            every = set().union(*groups)
            rows = [np.unique(np.concatenate([sets[i] for i in part])) for part in parts]
            whole = np.unique(np.concatenate(rows))
            least = len(sets[order[0]])
            columns = (questions.column(c).to_pylist() for c in ("a_size", "a_group", "shingles"))
            for size, name, query in zip(*columns):
                query = np.frombuffer(query, np.uint64)

                def reaches(tokens: np.ndarray, smallest: int, query: np.ndarray = query) -> bool:
                    # A link's intersection holds 75 of 175 parts of both sizes.
                    return (100 + NEEDED) * _common(query, tokens) >= NEEDED * (len(query) + smallest)

                def open_to(of: tuple[int, int], own: tuple[int, int] = (size, name)) -> bool:
                    return own < of and united.of(of[1]) != united.of(own[1])

                if not any(map(open_to, every)) or not reaches(whole, least):
                    continue
                for part, of, row in zip(parts, groups, rows):
                    if any(map(open_to, of)) and reaches(row, len(sets[part[0]])):
                        for i in part:
                            if open_to((sizes[i], names[i])) and reaches(sets[i], len(sets[i])):
                                united.unite(name, names[i])
                                found.append((name, names[i]))
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return left.groupBy("block", "lot").cogroup(right.groupBy("in_block", "in_lot")).applyInArrow(run, "a long, b long")


def _grouped(docs: DataFrame) -> DataFrame:
    """SIGNATURE of every document, and the group of its set."""
    ship_package(docs.sparkSession)
    base = scratch_path(docs.sparkSession, "jaccard")
    signatures(docs).write.parquet(f"{base}/signed")
    signed = docs.sparkSession.read.schema(SIGNATURE).parquet(f"{base}/signed")
    groups = linked_classes(docs, signed, base)
    return signed.join(groups, "set_id", "left").withColumn("group", F.coalesce("group", "set_id"))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id of every document."""
    rows = _grouped(docs).select("doc_id", "n_shingles", "set_id", "group")
    # The empty set links with nothing: such documents stay apart.
    least = rows.filter("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "group", "left").select(
        "doc_id",
        "n_shingles",
        "set_id",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    return joined(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id; of
    rows that share it, one with the smallest set. Rows of one id whose texts
    don't link are different components, and one of each stays; a row without an
    id stays only if its component has no other. Documents without words all stay."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_id", "text_hash")
    of_each = _grouped(docs.select("doc_id", "text")).filter("n_shingles > 0").groupBy("group").agg(F.min(first).alias("f"))
    stays = of_each.select(F.col("f.doc_id").alias("__doc"), F.col("f.text_hash").alias("__text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__text"))
    wordless = F.coalesce(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", ""), F.lit("")) == ""
    kept = docs.filter(~wordless).join(stays, same).dropDuplicates(["__doc", "__text"])
    return kept.unionByName(docs.filter(wordless), allowMissingColumns=True).select(*(f"`{c}`" for c in docs.columns))
