"""Match positions as plain SQL expressions (code points, end exclusive).

Spark returns the matches of a pattern (``regexp_extract_all``) but not their
places. ``split`` with the same pattern returns the text between the matches,
so the running sum of both lengths is the place of each match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are built in blocks of so many matches: appending to an array
#: copies it, so one pass over k matches would cost k * k.
BLOCK = 256

SPAN = "struct<start:int,end:int,gap:string,match:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find_all(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` in ``text``: leftmost, non-overlapping."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _running(steps: Column) -> Column:
    """Struct (pos, out): the places of ``steps`` counted from 0."""
    zero = F.struct(F.lit(0).alias("pos"), no_spans().alias("out"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["pos"] + F.char_length(s["gap"])
        end = start + F.char_length(s["match"])
        span = F.struct(start.alias("start"), end.alias("end"), s["gap"].alias("gap"), s["match"].alias("match"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, zero, add)


def locate(text: Column, matches: Column, pattern: str) -> Column:
    """Array of SPAN for ``matches = find_all(text, pattern)``."""
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")),
        lambda b: _running(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))),
    )
    zero = F.struct(F.lit(0).alias("pos"), no_spans().alias("out"))

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(
            b["out"],
            lambda s: F.struct(
                (s["start"] + acc["pos"]).alias("start"),
                (s["end"] + acc["pos"]).alias("end"),
                s["gap"].alias("gap"),
                s["match"].alias("match"),
            ),
        )
        return F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["out"], moved).alias("out"))

    return F.when(F.size(matches) == 0, no_spans()).otherwise(F.aggregate(blocks, zero, join)["out"])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each struct, comma-joined in array order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
