"""Secret scan (operator 2): trigram inverted index, then verification.

DataFrame functions only.

1. ``trigram_query`` derives from each rule's pattern the trigrams that any
   match must hold: a conjunction of clauses, each a choice of trigram sets.
   A rule that needs none has no clauses and scans every text.
2. ``postings`` is the inverted index over those trigrams: a row (trigram,
   document key) for each trigram a lower-cased text holds. Other trigrams
   take part in no query and get no postings.
3. ``candidates`` intersects the postings: a document stays for a rule if each
   clause has a set all of whose trigrams point to it. The rows of a document
   meet by document key, so a frequent trigram never lands in one task.
4. ``scan`` runs a rule's pattern on its candidates only.

Documents are keyed by (doc_id, hash of the text), so null or repeated ids do
no harm: a collision only adds a candidate. Defined results: null text counts
as empty, an empty text has no spans, repeated rows give repeated results.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from itertools import product
from re import _constants as rc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.llm import spans as sp


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # of the value's characters; shorter matches are dropped
    value: int = 0  # the group that holds the value


#: The three base rules in the contract's order, then added ones.
BASE = ("assign", "access", "hex")
RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
MOST_STRINGS = 64  # of an exact set; beyond it the set is closed and a new one begun

Clause = list[frozenset[str]]  # one of these sets must be there


def _clause(strings: set[str]) -> Clause | None:
    """The choice of trigram sets for 'one of these strings occurs'; None: no demand."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    fewest = [s for s in sets if not any(o < s for o in sets)]  # a larger set asks no more
    return None if frozenset() in sets else sorted(fewest, key=sorted)


def _strings(op, arg) -> set[str] | None:
    """All strings that a part of a pattern can match (lower case), if few."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        part = _strings(op, arg)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every text with a match of ``pattern`` fulfils (lower case)."""
    clauses: list[Clause] = []

    def close(strings: set[str]) -> None:
        if (c := _clause(strings)) is not None:
            clauses.append(c)

    def walk(seq) -> None:
        run = {""}
        for op, arg in seq:
            part = _strings(op, arg)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, part)}
                continue
            close(run)
            run = {""}
            if op is rc.SUBPATTERN:
                walk(arg[3])
            elif op is rc.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(sre.parse(pattern))
    return clauses


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__body", F.coalesce(F.col("text"), F.lit(""))).withColumn("__hash", F.xxhash64("__body"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id, __hash), one row for each trigram of a text."""
    low = _key(docs).select("doc_id", "__hash", F.lower("__body").alias("__low"))
    held = F.filter(F.array(*(F.lit(t) for t in trigrams)), lambda t: F.contains(F.col("__low"), t))
    return low.select("doc_id", "__hash", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, __hash, rules): the rules whose clauses the postings fulfil."""
    spark = index.sparkSession
    rows, needs = [], []
    for r in rules:
        clauses = trigram_query(r.pattern)
        if clauses:
            needs.append((r.kind, len(clauses)))
        for c, choice in enumerate(clauses):
            rows += [(r.kind, c, a, t, len(s)) for a, s in enumerate(choice) for t in sorted(s)]
    wanted = spark.createDataFrame(rows, "kind string, clause int, choice int, trigram string, need int")
    clauses = spark.createDataFrame(needs, "kind string, clauses int")
    key = ["doc_id", "__hash"]
    met = (
        index.join(F.broadcast(wanted), "trigram")  # a few hundred rows, set by the rules
        .groupBy(*key, "kind", "clause", "choice", "need")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = need")
        .groupBy(*key, "kind")
        .agg(F.countDistinct("clause").alias("met"))
    )
    return (
        met.join(F.broadcast(clauses), "kind")
        .filter("met = clauses")
        .groupBy(*key)
        .agg(F.collect_set("kind").alias("__rules"))  # as many as there are rules at most
    )


def _verified(nth: int, rule: Rule, body: Column, hits: Column) -> Column:
    """The spans of the matches whose value is long enough."""

    def ok(match: Column) -> Column:
        return F.char_length(F.regexp_extract(match, rule.pattern, rule.value)) >= rule.least

    at = F.when(F.exists(hits, ok), sp.locate(body, hits, rule.pattern)).otherwise(sp.no_spans())
    return F.transform(
        F.filter(at, lambda s: ok(s["match"])),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")
        ),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """``docs`` plus ``out`` (in place of a column of that name):
    array<struct<start,nth,end,kind>> by start, then rule."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    grams = sorted({t for r in indexed for c in trigram_query(r.pattern) for s in c for t in s})
    keyed = _key(docs)
    found = candidates(postings(docs, grams), tuple(indexed))
    found = found.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "__rules")
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["__hash"] == found["__h"]), "left")
    for r in rules:
        hits = sp.find_all(F.col("__body"), r.pattern)
        if r in indexed:
            hits = F.when(F.array_contains("__rules", r.kind), hits)
        both = both.withColumn(f"__{r.kind}", F.coalesce(hits, F.array().cast("array<string>")))
    for n, r in enumerate(rules):
        both = both.withColumn(f"__{r.kind}", _verified(n, r, F.col("__body"), F.col(f"__{r.kind}")))
    spans = F.array_sort(F.concat(*(F.col(f"__{r.kind}") for r in rules)))
    return both.select(*(keyed[f"`{c}`"] for c in docs.columns if c != out), spans.alias(out))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans per document."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col("secrets"), lambda s: s["kind"] == k)).cast("long")
    base = F.filter(F.col("secrets"), lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(sp.joined(base), 256).alias("base_sha256"),
        sp.joined(F.col("secrets")).alias("spans"),
    )


