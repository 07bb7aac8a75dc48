"""Best-fit packing of documents into sequences (operator 8): bin completion.

1. ``pieces`` encodes every text and cuts what is longer than a sequence.
   Only lengths and checksums leave the task, never ids.
2. Pieces are dealt by a hash of their row's number into groups of about
   ``GROUP`` pieces, so no source, length or copy collects in one task. A full piece is a sequence.
3. Each group is packed by bin completion: the largest open piece opens a
   sequence, the undominated fillings of its room are enumerated, those that
   waste least first, and a filling that wastes more than the best known
   solution allows is pruned. Best fit decreasing gives the first solution.
   At a dead end the search goes back to the last sequence with another
   filling; the sequences so far, with best fit for the rest, count as a
   solution too, and a better one tightens the bound.
4. Sequences that a group leaves with room are taken apart, and their pieces
   are packed again in fewer groups, until one group holds them all or nothing
   is gained. Each round keeps only what is badly filled, so the pieces left
   fall by the round.

A group's solution is the best one met within the search's step limits (a
sequence's listing, and a group's steps from its first dead end on). They bound
time and not what is packed: every piece is placed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.llm.tokens import word_ids
from milepost.llm.words import slices
from milepost.session import scratch_path, ship_package

CAPACITY = 4096
#: Pieces of a group, on average.
GROUP = 8192
#: Steps that the search for one sequence's filling may take.
STEPS = 400
#: Steps that a group's search may take after its first dead end.
NODES = 20_000
#: A sequence with more room than this share is taken apart for the next round.
LOOSE = 1 / 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBERED = f"{PIECES}, row long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: a document's ids and ``end_id``, cut every ``capacity``.

    Null text counts as empty: such a document is its end id alone. Repeated
    rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for b in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = zip(*rows) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in PIECES.split(", ")]
            )

    ship_package(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, PIECES)


# -- one group ----------------------------------------------------------------


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins as lists of sizes."""
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        k = bisect_right(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if room > s:
            insort(rooms, (room - s, b))
    return bins


def fillings(
    sizes: list[int], have: Counter, room: int, allowed: int, steps: int, every: bool = False, meter: list[int] | None = None
) -> list[list[int]]:
    """Fillings of ``room`` from ``have`` (``sizes``: its keys, ascending) that
    waste at most ``allowed`` and aren't dominated, least waste first: ``every``
    one, or those that waste less than the ones found before. ``meter[0]``
    counts the steps.

    Depth first from the largest size that fits. A filling into which another
    available size still fits is dominated by the larger one, so only maximal
    ones count; a branch ends when the sizes left can't bring the waste down.
    """
    best: list[tuple[int, list[int]]] = []
    limit = allowed
    left = steps

    def search(top: int, room: int, taken: list[int]) -> None:
        nonlocal limit, left
        k = bisect_right(sizes, min(room, top)) - 1
        grown = False
        while k >= 0 and left > 0 and limit >= 0:
            s = sizes[k]
            if have[s] > 0:
                left -= 1
                grown = True
                have[s] -= 1
                taken.append(s)
                search(s, room - s, taken)
                taken.pop()
                have[s] += 1
                if room - s > limit and 2 * s <= room and k == 0:
                    break
            k -= 1
        if not grown and room <= limit and not _fits(sizes, have, room):
            best.append((room, list(taken)))
            if not every:
                limit = room - 1  # from here on only what wastes less

    search(room, room, [])
    if meter is not None:
        meter[0] += steps - left
    return [f for _, f in sorted(best, key=lambda x: x[0])]


def _fits(sizes: list[int], have: Counter, room: int) -> bool:
    k = bisect_right(sizes, room) - 1
    while k >= 0:
        if have[sizes[k]] > 0:
            return True
        k -= 1
    return False


def bin_completion(sizes: list[int], capacity: int, steps: int = STEPS, nodes: int = NODES) -> list[list[int]]:
    """Bins for ``sizes``, never more than best fit decreasing gives.

    The bound: ceil(sum / capacity) bins at least. If best fit meets it, that
    is the optimum. Else bins are completed around the largest size left; the
    waste spent so far may not exceed what one bin fewer than the incumbent
    allows. Where no filling is left, the last bin that has another one takes
    it, until all are tried or ``nodes`` steps are spent.
    """
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    have = Counter(sizes)
    order = sorted(have)
    bins: list[list[int]] = []
    others: list[list[list[int]] | None] = []  # per bin: fillings not tried yet, None if not listed
    waste, deepest, meter, stuck = 0, -1, [0], False

    def close(largest: int, chosen: list[int], more: list[list[int]] | None) -> None:
        nonlocal waste
        have.subtract(chosen)
        waste += capacity - largest - sum(chosen)
        bins.append([largest, *chosen])
        others.append(more)

    while len(best) > least:
        while order and not have[order[-1]]:
            order.pop()
        spare = (len(best) - 1) * capacity - total - waste  # waste that a better solution may still have
        if order and spare >= 0:
            largest = order[-1]
            have[largest] -= 1
            found = fillings(order, have, capacity - largest, min(spare, capacity), steps, meter=meter)
            if found:
                close(largest, found[0], None)
                if len(order) > 64 and len(bins) % 64 == 0:
                    order = [s for s in order if have[s]]
                continue
            have[largest] += 1
        # A solution or a dead end.
        if not stuck:
            stuck, meter[0] = True, 0
        if not order or len(bins) > deepest:
            deepest = len(bins)
            rest = list(have.elements())
            meter[0] += len(rest)
            tail = best_fit(rest, capacity)
            if len(bins) + len(tail) < len(best):
                best = [list(b) for b in bins] + tail
        while bins and meter[0] < nodes:
            (largest, *chosen), more = bins.pop(), others.pop()
            have.update(chosen)
            room = capacity - largest
            waste -= room - sum(chosen)
            spare = (len(best) - 1) * capacity - total - waste
            if more is None and spare >= 0:
                order = sorted(s for s in have if have[s])
                meter[0] += len(order)
                listed = fillings(order, have, room, min(spare, capacity), steps, every=True, meter=meter)
                more = [f for f in listed if f != chosen]
            more = [f for f in more or [] if room - sum(f) <= spare]
            if more:
                close(largest, more[0], more[1:])
                order = sorted(s for s in have if have[s])
                break
            have[largest] += 1
        else:
            break
    return best


# -- all groups ---------------------------------------------------------------

PLACED = f"{NUMBERED}, sequence_id long, offset long, room long"


def _round(open_pieces: DataFrame, groups: int, nth: int, capacity: int) -> DataFrame:
    """Pack ``open_pieces`` in ``groups`` groups; sequence ids are unique to (round, group)."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        waiting: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            waiting.setdefault(int(lengths[i]), []).append(i)
        sequence = np.empty(len(pdf), np.int64)
        offset = np.empty(len(pdf), np.int64)
        room = np.empty(len(pdf), np.int64)
        for b, sizes in enumerate(bin_completion(lengths.tolist(), capacity)):
            at, rest = 0, capacity - sum(sizes)
            for s in sizes:
                i = waiting[s].pop()
                sequence[i], offset[i], room[i] = (nth << 56) | (int(key[0]) << 28) | b, at, rest
                at += s
        return pdf.drop(columns="bucket").assign(sequence_id=sequence, offset=offset, room=room)

    # By the row's own number: copies of a row are dealt out like any others.
    dealt = open_pieces.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(nth)), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(pack, PLACED)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place.

    Empty input gives no rows. Each round is written under spark.checkpoint.dir
    and read again, so a lost executor costs one round's work at most.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "packing")
    # A stored number for each row, as rows may repeat all else.
    numbered = pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id())
    numbered.write.parquet(f"{base}/pieces")
    spread = spark.read.schema(NUMBERED).parquet(f"{base}/pieces")
    full = spread.filter(F.col("length") == capacity)
    left = spread.filter(F.col("length") < capacity)
    done: list[DataFrame] = []
    n, nth = left.count(), 1
    while True:
        groups = max(1, round(n / group))
        _round(left, groups, nth, capacity).write.parquet(f"{base}/round{nth}")
        placed = spark.read.schema(PLACED).parquet(f"{base}/round{nth}")
        loose = placed.filter(F.col("room") > int(capacity * LOOSE))
        m = loose.count() if groups > 1 else 0
        if not m or m > 0.7 * n:
            done.append(placed)
            break
        done.append(placed.filter(F.col("room") <= int(capacity * LOOSE)))
        left, n, nth = loose.select(*spread.columns), m, nth + 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # Negative: those of the rounds are not.
    whole = full.withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    out = None
    for part in done:
        out = part.select(*names) if out is None else out.unionByName(part.select(*names))
    return out.unionByName(whole.select(*names))
