"""Document fingerprints (operator 5): order min-hash, DataFrame functions only.

A k-mer is ``K`` consecutive words; the n-th time it occurs in a text counts as
another one (occurrence number). Each of ``TUPLES`` tuples has one hash function,
which puts a text's k-mers in an order: the ``PICKS`` least are chosen, put in the
order in which they stand in the text, and hashed. Texts that share many k-mers in
the same order share many tuples, so the share of equal tuples follows their edit
distance, which a plain min-hash doesn't see.

Plan: rows are keyed by id and text hash; equal rows are one key with their number.
1. The keys, without texts, are written in order with row numbers; a window within
   each range, and one row per range, give every key its successor.
2. A text meets its own key, and the beginning that its predecessor asks for meets
   the predecessor: texts are shuffled once by their key, beginnings once.
3. K-mers, occurrence numbers and minima keep that partitioning.
4. Fingerprints, which are narrow, meet those of their successors.
Texts of a key that has more than a ``SHARE``-th of all rows are aggregated before
they are shuffled. The results don't depend on the number of partitions.

Defined results: null text counts as empty; an empty text has no k-mer and the
fingerprint of TUPLES zeros; a text of one word has one k-mer, and tuples of one.
Null ids come first; rows of one id follow each other by a hash of their text, so
equal rows follow themselves. The only document of a table is its own successor.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from milepost.session import scratch_path

K = 2
TUPLES = 16
PICKS = 2
#: Bits of a minimum that hold the position; the hash has the 31 above them.
POSITION_BITS = 31
#: A key is frequent with more than OFTEN rows and more than such a share of all.
SHARE = 10_000
OFTEN = 1000
#: Characters of texts that one task has on average, up to so many tasks; beyond
#: them tasks grow, and their sorts go to disk.
PART = 1 << 22
MOST_PARTS = 50_000

KEY = ["named", "id", "tie"]


def _kmers(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key``, pos and h: hashes of each row's K-word windows (the last one ends
    short). No lambda: these run outside generated code, once a word. For a plain
    posexplode Spark would split each text again, to drop those without words."""
    words = F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), "")
    split = rows.select(*key, words.alias("words"))
    each = split.select(*key, "words", F.posexplode_outer("words").alias("pos", "word"))
    return each.filter("pos is not null").select(*key, "pos", F.xxhash64("word", F.get("words", F.col("pos") + 1)).alias("h"))


def minima(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` plus ``tuples`` (array of TUPLES hashes) of each row with a k-mer.

    The rows' partitioning must keep a key's rows together; nothing is shuffled.
    """
    each = _kmers(rows, key, text)
    numbered = each.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "h").orderBy("pos")))
    based = numbered.select(*key, "pos", F.xxhash64("h", "nth").alias("h"))

    def rank(t: int) -> Column:
        """Place of a k-mer in the order of tuple t: its hash, and its position below."""
        top = F.shiftleft(F.shiftrightunsigned(F.xxhash64("h", F.lit(t)), 64 - 31), POSITION_BITS)
        return top.bitwiseOR(F.col("pos").cast("long"))

    whole = Window.partitionBy(*key)
    for p in range(PICKS - 1):
        after = [F.col(f"m{t}_{p - 1}") if p else None for t in range(TUPLES)]
        picked = [F.min(rank(t) if a is None else F.when(rank(t) > a, rank(t))).over(whole) for t, a in enumerate(after)]
        based = based.select("*", *(c.alias(f"m{t}_{p}") for t, c in enumerate(picked)))
    last = [F.min(F.when(rank(t) > F.col(f"m{t}_{PICKS - 2}"), rank(t))) for t in range(TUPLES)]
    firsts = [F.min(f"m{t}_{p}").alias(f"m{t}_{p}") for p in range(PICKS - 1) for t in range(TUPLES)]
    least = based.groupBy(*key).agg(*firsts, *(c.alias(f"m{t}_{PICKS - 1}") for t, c in enumerate(last)))

    def one(t: int) -> Column:
        picks = F.array_compact(F.array(*(F.col(f"m{t}_{p}") for p in range(PICKS))))
        place = F.lit((1 << POSITION_BITS) - 1)
        placed = F.array_sort(
            F.transform(
                picks, lambda m: F.struct(m.bitwiseAND(place).alias("pos"), F.shiftright(m, POSITION_BITS).alias("h"))
            )
        )
        return F.xxhash64(F.lit(t), F.transform(placed, lambda s: s["h"]))

    return least.select(*key, F.array(*(one(t) for t in range(TUPLES))).alias("tuples"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same / F.lit(float(TUPLES))


def as_text(tuples: Column) -> Column:
    return F.array_join(F.transform(tuples, lambda t: F.lpad(F.lower(F.hex(t)), 16, "0")), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """KEY and text of every row; null ids before all others."""
    text = F.coalesce("text", F.lit(""))
    named, number = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    return docs.select(named.alias("named"), number.alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _successors(keys: DataFrame) -> DataFrame:
    """``keys`` (KEY, n_chars, copies, row; written, ``row`` in order) plus ``next``,
    the KEY of the following one (of the first, after the last)."""
    ranges = keys.withColumn("range", F.shiftright("row", 33))  # monotonically_increasing_id: range, place in it
    heads = ranges.groupBy("range").agg(F.min_by(F.struct(*KEY), "row").alias("head"))
    order = Window.orderBy("range")  # a row per range
    chain = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("beyond"))
    within = F.lead(F.struct(*KEY)).over(Window.partitionBy("range").orderBy("row"))
    # As many rows as ranges, small whatever the table's size.
    found = ranges.withColumn("within", within).join(F.broadcast(chain), "range")
    return found.select(*keys.columns, F.coalesce("within", "beyond").alias("next"))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row per KEY; ``rows`` come from a join on it, so they lie together."""
    others = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in others))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    rows = _keyed(docs)
    counted = rows.groupBy(*KEY).agg(
        F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )
    ordered = counted.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ordered.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/keys")
    keys = spark.read.schema("named boolean, id long, tie long, n_chars long, copies long, row long").parquet(f"{path}/keys")
    _successors(keys).write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    total, chars = links.agg(F.sum("copies"), F.sum("n_chars")).first()
    total, chars = total or 0, chars or 0
    # K-mers take many times the room of their text, so a task has few texts.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(-(-chars // PART), MOST_PARTS))
    # Less than SHARE keys.
    often = links.filter(F.col("copies") > max(OFTEN, total // SHARE)).select(*KEY)
    if not often.isEmpty():
        several = rows.join(F.broadcast(often), KEY)
        rows = rows.join(F.broadcast(often), KEY, "left_anti").unionByName(
            several.groupBy(*KEY).agg(F.first("text").alias("text"))
        )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *KEY)

    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    texts = dealt(rows)  # the one shuffle of whole texts: both uses share it
    asks = dealt(links.select("next.*", F.struct(*KEY).alias("for"), quarter.alias("quarter")))
    begun = _one_of_each(texts.join(asks, KEY))
    begun = dealt(begun.select("for.*", F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("following")))
    own = _one_of_each(texts.join(dealt(links.select(*KEY, "n_chars", "copies", "next")), KEY)).join(begun, KEY)
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    again = F.concat(kept, F.substring(F.col("text"), F.lit(1), quarter))  # a copy follows
    full = own.withColumns(
        {"edited": F.concat(kept, "following"), "edited_copy": F.when(F.col("copies") > 1, again)}
    )
    variant = F.posexplode(F.array("text", "edited", "edited_copy")).alias("variant", "body")
    versions = full.select(*KEY, variant).filter("body is not null")
    tuples = minima(versions, [*KEY, "variant"], "body")
    which = lambda v: F.max(F.when(F.col("variant") == v, F.col("tuples")))
    sets = tuples.groupBy(*KEY).agg(which(0).alias("own"), which(1).alias("new"), which(2).alias("copy"))
    none = F.array_repeat(F.lit(0).cast("long"), TUPLES)
    info = full.select(
        *KEY,
        "n_chars",
        "copies",
        "next",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.sha2("edited_copy", 256).alias("copy_sha256"),
    )
    both = info.join(sets, KEY, "left").withColumns({c: F.coalesce(c, none) for c in ("own", "new", "copy")})
    both.write.parquet(f"{path}/sets")
    both = spark.read.schema(both.schema).parquet(f"{path}/sets")

    after = both.select(F.struct(*KEY).alias("next"), F.col("own").alias("following"))
    placed = both.join(after, "next")
    last = F.struct(F.col("edited_sha256").alias("sha"), F.col("new").alias("new"), F.col("following").alias("after"))
    copy = F.struct(F.col("copy_sha256").alias("sha"), F.col("copy").alias("new"), F.col("own").alias("after"))
    # All copies but the last follow themselves.
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda n: F.when(n == 1, last).otherwise(copy))
    each = placed.select("*", F.explode(copies).alias("v"))
    return each.select(
        F.when(F.col("named"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.col("v.sha").alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("v.new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("v.new")).alias("near_edited"),
        likeness(F.col("own"), F.col("v.after")).alias("near_next"),
    )
