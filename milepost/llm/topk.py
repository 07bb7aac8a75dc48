"""Exact top-k search (operator 6): three-phase uniform threshold.

A vector's components are dealt to ``SLICES`` lists; a list scores a vector by
the inner product over its own components. The score is the sum over lists.

1. Each list sends, per query, the k + 1 best vectors of each of its blocks and its
   least score. These heads are scored exactly; the k-th best of them is a safe
   cutoff: no result can score less.
2. Every list gets each query's cutoff. Counted from the lists' least scores, a
   vector that reaches the cutoff has at least 1/SLICES of it in some list, so
   each list sends all entries from there on.
3. The entries of a vector are added up; a missing list can add less than its
   share. Vectors whose bound reaches the cutoff are scored exactly.

Queries and vectors meet in blocks: a cell is one block of queries and a group of
blocks of vectors, with all lists of both, so entries are added up where they are
made, and only vectors that reach the cutoff (the best of a cell) leave it. A block
of queries is sent once to each group, not to each block, and a vector once to each
block of queries; no join of a table that grows with the input is broadcast, as
Parquet's sizes, by which Spark would choose, are a fraction of the rows'.

Equal vectors are one class, with the k + 1 smallest of its distinct ids and how
often each occurs: more can't matter to a query. An id of one class only costs a
query one id when it is the query's own; only such ids count towards the cutoff.

Defined results: components become floor(256 * x); a vector that is null or
empty, or holds a null or non-finite component, takes no part, nor does a null
id. Each row counts: a row that repeats an id, with the same vector or another,
is a candidate (and asks, if it is a query) once more; a query meets no row of
its own id. Shorter vectors count as if filled up with 0.
Fewer candidates than k give fewer ranks; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from milepost.session import scratch_path, ship_package

SLICES = 2
#: Most queries and vectors of a block, and components of either.
QUERY_BLOCK = 1 << 15
VECTOR_BLOCK = 2048
QUERY_VALUES = 1 << 21
VECTOR_VALUES = 1 << 17
#: Most blocks of vectors in a group, least cells for each core, and most partitions that they are dealt to.
GROUP = 128
CELLS = 4
PARTITIONS = 2000
#: Queries that are scored at once, and rows that a cell gathers before it leaves out what can't be a result.
TILE = 256
GATHERED = 1 << 20

_LEAST = [f"least_{i}" for i in range(SLICES)]
#: What a cell needs of its vectors besides their components.
_OF_VECTORS = ["least_id", "lead", "singles"]
_NONE = np.iinfo(np.int64).min

BLOCK = "block int, ids array<long>, width int, lists array<binary>, more array<array<long>>"
HEADS = f"query long, {', '.join(f'{x} long' for x in _LEAST)}, scores array<long>, counts array<long>"
FOUND = "query long, vector long, score long, least_id long, lead long"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as long; null unless all are finite numbers."""
    finite = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False))
    )
    return F.when((F.size(vector) > 0) & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def _size(most: int, values: int, dims: int) -> int:
    """Vectors of a block."""
    return min(most, max(1, values // dims))


def _blocks(classes: DataFrame, n: int, dims: int, more: list[str]) -> DataFrame:
    """BLOCK in ``n`` rows or fewer: vectors with each list's components as integers of
    ``width`` bytes, and their columns ``more``."""
    cuts = np.linspace(0, dims, SLICES + 1).astype(int)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        whole = np.zeros((len(pdf), dims), np.int64)
        for i, v in enumerate(pdf["v"]):
            whole[i, : len(v)] = v
        width = next(w for w in (2, 4, 8) if w == 8 or -(2 ** (8 * w - 1)) <= whole.min() and whole.max() < 2 ** (8 * w - 1))
        lists = [whole[:, a:z].astype(f"i{width}").tobytes() for a, z in zip(cuts[:-1], cuts[1:])]
        row = {"block": key[0], "ids": pdf["id"].to_numpy(), "width": width, "lists": lists, "more": [pdf[c].to_numpy(np.int64) for c in more]}
        return pd.DataFrame({c: [x] for c, x in row.items()}).astype({"block": np.int32, "width": np.int32})

    dealt = classes.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "v", *more)
    return dealt.groupBy("block").applyInPandas(run, BLOCK)


def _cells(queries: DataFrame, n_query: int, vectors: DataFrame, n_vector: int) -> DataFrame:
    """BLOCK with its cell: each cell's block of queries, then its blocks of vectors."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = min(n_vector, max(-(-n_vector // GROUP), -(-CELLS * cores // n_query)))
    n = F.lit(groups)
    every = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - 1)))
    asks = queries.withColumn("other", every(groups)).withColumn("cell", F.col("block") * n + F.col("other")).withColumn("kind", F.lit(0))
    meets = vectors.withColumn("other", every(n_query)).withColumn("cell", F.col("other") * n + F.pmod("block", n)).withColumn("kind", F.lit(1))
    parts = min(PARTITIONS, n_query * groups)
    dealt = asks.unionByName(meets).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("cell", "kind", "block").select("cell", "kind", "ids", "width", "lists", "more")


class _Block(NamedTuple):
    cell: int
    ids: np.ndarray
    lists: list[np.ndarray]
    more: list[np.ndarray]
    most: float


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    """(queries, vectors) of _cells' rows; a block that the hash left empty has no row."""
    queries, last = None, (0, 0)
    for b in batches:
        for r in b.to_struct_array():
            ids = r["ids"].values.to_numpy(zero_copy_only=False)
            width = r["width"].as_py()
            lists = [np.frombuffer(x.as_buffer(), f"i{width}").reshape(len(ids), -1) for x in r["lists"].values]
            most = max(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in lists)
            block = _Block(r["cell"].as_py(), ids, lists, [x.values.to_numpy(zero_copy_only=False) for x in r["more"].values], float(most))
            if (last := max(last, at := (block.cell, r["kind"].as_py()))) != at:
                raise RuntimeError(f"{at} comes after {last}")
            if at[1] == 0:
                queries = block
            elif queries is not None and queries.cell == block.cell:
                yield queries, block


def _tiles(queries: _Block, vectors: _Block) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Queries, and each list's exact inner products; in floats where they are exact, which is faster."""
    most = queries.most * vectors.most * max(1, *(x.shape[1] for x in vectors.lists))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    against = [x.astype(kind).T for x in vectors.lists]
    for a in range(0, len(queries.ids), TILE):
        tile = slice(a, min(a + TILE, len(queries.ids)))
        yield tile, [q[tile].astype(kind) @ v for q, v in zip(queries.lists, against)]


def _first_phase(keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """HEADS: per cell and query the lists' least scores and the ``keep`` best of the heads."""
    for _, met in groupby(_meetings(batches), key=lambda x: x[0].cell):
        scores = None
        for queries, vectors in met:
            if scores is None:
                asked = queries.ids
                least = np.full((SLICES, len(asked)), np.iinfo(np.int64).max)
                scores, counts = np.full((len(asked), keep), _NONE), np.zeros((len(asked), keep), np.int64)
            some = min(keep, len(vectors.ids))
            singles = vectors.more[_OF_VECTORS.index("singles")]
            for tile, parts in _tiles(queries, vectors):
                heads = np.sort(np.concatenate([np.argpartition(p, -some, axis=1)[:, -some:] for p in parts], axis=1), axis=1)
                exact = sum(np.take_along_axis(p, heads, axis=1).astype(np.int64) for p in parts)
                n = singles[heads]
                n[:, 1:][heads[:, 1:] == heads[:, :-1]] = 0  # of another list, too
                exact[n == 0] = _NONE
                exact, n = np.concatenate([scores[tile], exact], axis=1), np.concatenate([counts[tile], n], axis=1)
                best = np.argsort(exact, axis=1)[:, -keep:]
                scores[tile], counts[tile] = np.take_along_axis(exact, best, axis=1), np.take_along_axis(n, best, axis=1)
                for i, p in enumerate(parts):
                    least[i, tile] = np.minimum(least[i, tile], p.min(axis=1).astype(np.int64))
        ends = pa.array(np.arange(0, scores.size + 1, keep, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (scores, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(asked), *map(pa.array, least), *lists], names=["query", *_LEAST, "scores", "counts"])


def _foremost(found: list[list[np.ndarray]], keep: int) -> list[np.ndarray]:
    """Of (query, vector, score, least_id, lead) what has fewer than ``keep`` leads ahead."""
    query, vector, score, least_id, lead = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((vector, least_id, -score, query))
    leads = np.cumsum(lead[order]) - lead[order]
    first = np.flatnonzero(np.diff(query[order], prepend=-1))  # queries count from 0
    ahead = leads - np.repeat(leads[first], np.diff(np.append(first, len(order))))
    order = order[ahead < keep]
    return [x[order] for x in (query, vector, score, least_id, lead)]


def _second_phase(keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND: vectors that reach the cutoff, of a cell's queries; the third phase follows where the entries are."""
    for _, met in groupby(_meetings(batches), key=lambda x: x[0].cell):
        found: list[list[np.ndarray]] = []
        rows = 0
        for queries, vectors in met:
            asked = queries.ids
            *least, cutoff = queries.more
            above = cutoff - sum(least)
            share = -(-above // SLICES)  # a vector at the cutoff has as much in some list
            least_id, lead, _ = vectors.more
            for tile, parts in _tiles(queries, vectors):
                sends = [(x[tile] + share[tile]).astype(parts[0].dtype)[:, None] for x in least]
                at = np.flatnonzero(np.logical_or.reduce([p >= x for p, x in zip(parts, sends)]))
                qi, vi = at // len(vectors.ids), at % len(vectors.ids)
                entries = [p.ravel()[at].astype(np.int64) for p in parts]
                qi += tile.start
                known, missing = np.zeros(len(at), np.int64), np.full(len(at), SLICES)
                for part, x in zip(entries, least):
                    sent = part - x[qi] >= share[qi]
                    known += np.where(sent, part - x[qi], 0)
                    missing -= sent
                # What a list didn't send is below its share of the cutoff.
                possible = known + missing * np.maximum(share[qi] - 1, 0) >= above[qi]
                qi, vi, score = qi[possible], vi[possible], sum(x[possible] for x in entries)
                if queries.most * vectors.most * sum(x.shape[1] for x in vectors.lists) >= 2**63:
                    about = sum(q[tile].astype(float) @ v.astype(float).T for q, v in zip(queries.lists, vectors.lists))
                    if np.abs(about.ravel()[at[possible]]).max(initial=0) >= 2**63:
                        raise OverflowError("a score is beyond 64 bits")
                reach = score >= cutoff[qi]
                qi, vi = qi[reach], vi[reach]
                if len(qi):
                    found.append([qi, vectors.ids[vi], score[reach], least_id[vi], lead[vi]])
                    rows += len(qi)
                if rows > GATHERED:
                    found = [_foremost(found, keep)]
                    rows = len(found[0][0])
                    if rows > GATHERED // 2:
                        yield _batch(asked, found[0])
                        found, rows = [], 0
        if found:
            yield _batch(asked, _foremost(found, keep))


def _batch(asked: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[found[0]], *found[1:])], names=[c.split()[0] for c in FOUND.split(", ")])


def _merged(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A join without a broadcast."""
    return left.join(right.hint("merge"), on)


def _best(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best, its own row apart."""
    spark = table.sparkSession
    ship_package(spark)
    base = scratch_path(spark, "topk")
    rows = (
        table.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), quantised(F.col(vector)).alias("v"))
        .filter("id is not null and v is not null")
    )
    # Classes of equal vectors, named by a hash, as an id may come with several vectors.
    times = rows.groupBy("id", "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("is_query", F.lit(False)).cast("long")).alias("asked")
    )
    times.write.parquet(f"{base}/times")
    times = spark.read.schema("id long, v array<long>, n long, asked long").parquet(f"{base}/times")
    few = _best(times.select("id", "v", "n"), ["v"], [F.col("id")], k + 1)
    alone = few.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    each = _merged(few, alone, "id").select("v", F.struct("id", F.least("n", F.lit(k)).alias("n"), "alone").alias("of"))
    classes = each.groupBy("v").agg(F.array_sort(F.collect_list("of")).alias("ids"))
    classes = classes.withColumn("id", F.xxhash64("v")).select("id", "v", "ids", F.col("ids")[0]["id"].alias("least_id"))
    classes.write.parquet(f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")
    asked = times.filter("asked > 0").select(F.col("id").alias("query_id"), F.xxhash64("v").alias("query"), "asked")
    wanted = _merged(asked.select(F.col("query").alias("id")).distinct(), classes, "id").select("id", "v")
    wanted.write.parquet(f"{base}/queries")
    wanted = spark.read.parquet(f"{base}/queries")
    n_class, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_wanted = wanted.count()
    answer = "query_id long, rank int, vec_id long, score long"
    if not n_wanted:
        return spark.createDataFrame([], answer)
    n_vector = -(-n_class // _size(VECTOR_BLOCK, VECTOR_VALUES, dims))
    n_query = -(-n_wanted // _size(QUERY_BLOCK, QUERY_VALUES, dims))
    singles = F.size(F.filter("ids", lambda x: x["alone"])).cast("long")
    told = classes.select("id", "v", "least_id", F.col("ids")[0]["alone"].cast("long").alias("lead"), singles.alias("singles"))
    _blocks(told, n_vector, dims, _OF_VECTORS).write.parquet(f"{base}/vector_blocks")
    vector_blocks = spark.read.parquet(f"{base}/vector_blocks")
    keep = k + 1  # one may be the query itself
    cells = _cells(_blocks(wanted, n_query, dims, []), n_query, vector_blocks, n_vector)
    local = cells.mapInArrow(lambda batches: _first_phase(keep, batches), HEADS)
    # The cutoff counts ids, as a class of copies fills several ranks.
    heads = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("scores", "counts"))), asc=False)
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("cutoff"))
    cutoff = F.aggregate(
        "heads",
        nothing,
        lambda s, x: F.struct(
            (s["n"] + x["counts"]).alias("n"), F.coalesce(s["cutoff"], F.when(s["n"] + x["counts"] >= keep, x["scores"])).alias("cutoff")
        ),
    )["cutoff"]
    limits = local.groupBy("query").agg(*(F.min(x).alias(x) for x in _LEAST), heads.alias("heads"))
    limits = limits.select(
        F.col("query").alias("id"),
        *_LEAST,
        F.coalesce(cutoff, sum(map(F.col, _LEAST), F.lit(0))).alias("cutoff"),  # too few candidates: everything is sent
    )
    limits.write.parquet(f"{base}/limits")
    limits = spark.read.parquet(f"{base}/limits")
    # Each query block takes its own queries' limits along.
    limited = _blocks(_merged(wanted, limits, "id"), n_query, dims, [*_LEAST, "cutoff"])
    reached = _cells(limited, n_query, vector_blocks, n_vector).mapInArrow(lambda batches: _second_phase(keep, batches), FOUND)
    # Of k + 1 classes whose least id is alone, a query's own id is that of one at most.
    ahead = Window.partitionBy("query").orderBy(F.desc("score"), "least_id", "vector").rowsBetween(Window.unboundedPreceding, -1)
    best = reached.withColumn("ahead", F.coalesce(F.sum("lead").over(ahead), F.lit(0))).filter(F.col("ahead") < keep)
    named = _merged(best.select("query", "vector", "score"), classes.select(F.col("id").alias("vector"), "ids"), "vector")
    # As many rows per query as its best classes have ids: (k + 1) squared where ids are unique.
    lists = named.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    each = _merged(asked, lists, "query").select("query_id", "asked", F.explode("found").alias("f"))
    each = each.select("query_id", "asked", F.col("f.score").alias("score"), F.explode("f.ids").alias("of"))
    each = each.filter("of.id <> query_id").withColumn("rows", F.least(F.col("asked") * F.col("of.n"), F.lit(k)))
    # Ranked within the query's own rows; the id may be asked for more than once.
    rows_of = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows").cast("long")))
    each = each.select("query_id", "score", F.col("of.id").alias("vec_id"), rows_of.alias("row"))
    ranked = _best(each, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
