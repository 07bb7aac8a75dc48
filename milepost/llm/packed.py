"""Token ids in a bit-packed file format (operator 9).

Every id takes the minimum number of bits of the vocabulary. Ids are stored in
blocks of whole documents; a block is a row of a Parquet table, so Spark's
commit protocol covers lost executors and any file system serves:

    part int          files' order: parts are ranges of ascending doc_id
    block int         order within the part
    start long        ids before the block within the part
    n_ids int         ids in the block
    width int         bits an id takes
    doc_ids array     ids of the documents, in order (null ids first)
    offsets array     first id of each document within the block, and n_ids
    payload binary    the ids, little-endian bit order, padded to a byte

``parts`` beside it holds each part's count and the ids before it. A document
is found by its block's doc_ids, and read from bit ``offset * width`` on;
``unpack`` does so for any range of a block without touching the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer

from milepost.llm.tokens import byte_ids
from milepost.llm.words import slices
from milepost.session import ship_package

#: A block is closed at the first document that brings it to so many ids.
BLOCK_IDS = 1 << 16

BLOCK_SCHEMA = (
    "part int, block int, start long, n_ids int, width int, "
    "doc_ids array<long>, offsets array<int>, payload binary"
)


ARROW = pa.schema(
    [
        *((c, pa.int32()) for c in ("part", "block")),
        ("start", pa.int64()),
        *((c, pa.int32()) for c in ("n_ids", "width")),
        ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)


def bits_for(vocabulary_size: int) -> int:
    """Bits that the largest id of a vocabulary takes."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, least significant bit first. An id that
    doesn't fit is an error."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} takes more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on, as uint32; reads only their bytes."""
    if not count:
        return np.empty(0, np.uint32)
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", count, start * size).astype(np.uint32)
    first = start * width // 8
    last = ((start + count) * width + 7) // 8
    raw = np.frombuffer(payload[first:last] + bytes(8), np.uint8).astype(np.uint64)
    bit = np.arange(start, start + count, dtype=np.int64) * width - first * 8
    at, shift = bit >> 3, (bit & 7).astype(np.uint64)
    value = np.zeros(count, np.uint64)
    for k in range(5):  # 32 bits at any shift touch five bytes at most
        value |= raw[at + k] << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def vocabulary_size(tokenizer: str) -> int:
    """Ids of a tokenizer file, added tokens included: the largest plus one."""
    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Null text counts as empty: such a document holds the end id alone. Null
    ids come first; rows with the same id follow each other by a hash of their
    text, which also lets the ranges split an id that very many rows share.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = bits_for(max(vocabulary_size(tokenizer), end_id + 1))
    narrow = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie")
    )
    ordered = narrow.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        block = start = 0
        names: list[int | None] = []  # Arrow keeps null ids apart from numbers
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            offsets = np.concatenate([[0], np.cumsum([len(h) // 4 for h in held])]).astype(np.int32)
            row = (part, block, start, len(ids), width, list(names), offsets, pack(ids, width))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW)], schema=ARROW)

        for b in slices(batches, "text"):
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append(encoder.encode(text) + end)
                names.append(name)
                size += len(held[-1]) // 4
                if size >= BLOCK_IDS:
                    yield closed()
                    block, start, size = block + 1, start + size, 0
                    names, held = [], []
        if held:
            yield closed()

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are parts
    totals.select("part", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.parquet(
        f"{path}/parts"
    )


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, each with the ids of all blocks before it (``first``)."""
    base = spark.read.schema("part int, n_ids long, base long").parquet(f"{path}/parts").select("part", "base")
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return rows.join(F.broadcast(base), "part").withColumn("first", F.col("base") + F.col("start"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"]).astype("<u4")
                ends = np.asarray(r["offsets"], np.int64)
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(ends[:-1], ends[1:])]
                columns = [r["doc_ids"], r["first"] + ends[:-1], np.diff(ends), crc]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    ship_package(spark)
    rows = blocks(spark, path).select("width", "n_ids", "first", "doc_ids", "offsets", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Random access: (doc_id, ids) of the given documents; other payloads stay packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(doc_ids)
        for b in batches:
            for r in b.to_pylist():
                found = [k for k, d in enumerate(r["doc_ids"]) if d in wanted]
                ids = [unpack(r["payload"], r["width"], r["offsets"][k], r["offsets"][k + 1] - r["offsets"][k]) for k in found]
                columns = [pa.array([r["doc_ids"][k] for k in found], pa.int64()), pa.array(ids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    ship_package(spark)
    rows = blocks(spark, path).filter(F.arrays_overlap("doc_ids", F.array(*(F.lit(d).cast("long") for d in doc_ids))))
    return rows.select("width", "doc_ids", "offsets", "payload").mapInArrow(run, "doc_id long, ids array<long>")
