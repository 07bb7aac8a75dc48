"""Words of whole texts as 64-bit hashes, many texts at a time.

A word is a run of bytes other than blank and U+0009 to U+000D, in UTF-8; these
bytes stand for nothing else there, so runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time.
SLAB = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def run_hashes(joined: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of bytes that aren't ``blank``; the last byte is."""
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(begins):
        return begins, np.empty(0, np.uint64)
    # Place of each byte in its word: bytes since the last beginning.
    start = np.zeros(len(joined), np.int64)
    start[begins] = begins
    place = (np.arange(len(joined)) - np.maximum.accumulate(start)).astype(np.uint64)
    value = joined.astype(np.uint64) * _ODD + place * _STEP + np.uint64(1)
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    value[blank] = 0
    return begins, mix(np.add.reduceat(value, begins))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more at the end)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins, hashes = run_hashes(joined, (joined == 32) | ((joined >= 9) & (joined <= 13)))
    ends = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(begins, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (a row of texts' words)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = out * _STEP + words[k : k + n]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLAB) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about ``size`` bytes of a text column, so that
    what a worker makes of them doesn't grow with the batch; a row stays whole."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        slab = (ends - 1).clip(0) // size
        starts = np.flatnonzero(np.concatenate([[True], slab[1:] != slab[:-1]]))
        for a, z in zip(starts, [*starts[1:], b.num_rows]):
            yield b.slice(int(a), int(z - a))


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, like bytes side by side: sorted ones compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(columns: list[bytes]) -> np.ndarray:
    """The numbers of several ``packed``, one after another."""
    each = [np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for c in columns]
    return np.concatenate([np.empty(0, np.uint64), *each])
