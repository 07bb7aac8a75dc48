"""Personal data (operator 7): patterns propose, checksums confirm, context scores.

DataFrame functions only. Each kind has a pattern, a check of the match and a
list of context words. A proposal that fails its check is dropped and not
tried again. ``score`` is the kind's weight, raised when one of its context
words stands in the 40 characters before the match (after the previous match
of that kind).

The patterns are those of the contract, with possessive repeats and a guard
(``\\G`` or "not preceded by the same class") that keeps a long run of one
class from being tried from each of its places; the matches are the same.

Defined results: null text counts as empty; empty text has no spans; repeated
rows are judged each on their own; other columns are kept untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.llm import spans as sp


def _start(cls: str) -> str:
    return rf"(?:\G|(?<![{cls}]))"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the decimal string passes the Luhn checksum."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
            F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the compact IBAN leaves 1 on division by 97 (letters as 10..35)."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = c.try_cast("int")
        return F.when(digit.isNotNull(), (acc * 10 + digit) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _email_ok(m: Column) -> Column:
    return F.lit(True)


def _ip_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.char_length(d).between(16, 19) & luhn(d)


def _phone_ok(m: Column) -> Column:
    return F.char_length(_digits(m)).between(8, 15)


def _iban_ok(m: Column) -> Column:
    c = F.regexp_replace(m, " ", "")
    return F.char_length(c).between(15, 34) & mod97(c)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a character without which no match exists; "" if none
    ok: Callable[[Column], Column]
    weight: float
    context: tuple[str, ...]


#: The four base kinds in the contract's order, then the added one.
KINDS = (
    Kind(
        "email",
        _start("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        _email_ok,
        0.8,
        ("mail", "contact", "write", "reach"),
    ),
    Kind(
        "ip",
        _start("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".",
        _ip_ok,
        0.6,
        ("ip", "host", "server", "address", "login"),
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card_ok, 0.8, ("card", "visa", "credit", "payment", "account")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone_ok, 0.6, ("phone", "call", "tel", "mobile", "fax")),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        "",
        _iban_ok,
        0.9,
        ("iban", "bank", "account", "transfer"),
    ),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.1


def _score(kind: Kind, gap: Column) -> Column:
    near = F.lower(F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS))
    hit = near.rlike("(?<![a-z])(?:" + "|".join(kind.context) + ")")
    return F.lit(kind.weight) + F.when(hit, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))


def _confirmed(kind: Kind, body: Column, hits: Column) -> Column:
    """The spans of the matches that pass their check; places are only worked
    out where there is such a match."""
    at = F.when(F.exists(hits, kind.ok), sp.locate(body, hits, kind.pattern)).otherwise(sp.no_spans())
    return F.transform(
        F.filter(at, lambda s: kind.ok(s["match"])),
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            _score(kind, s["gap"]).alias("score"),
        ),
    )


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` plus ``out``: array<struct<kind,start,end,score>> by kind, then start."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found, tmp = docs, {k.name: f"__{out}_{k.name}" for k in KINDS}
    for k in KINDS:
        hits = sp.find_all(body, k.pattern)
        hits = F.when(F.contains(body, F.lit(k.needs)), hits).otherwise(F.array().cast("array<string>")) if k.needs else hits
        found = found.withColumn(tmp[k.name], hits)
    for k in KINDS:
        found = found.withColumn(tmp[k.name], _confirmed(k, body, F.col(tmp[k.name])))
    return found.withColumn(out, F.concat(*(F.col(tmp[k.name]) for k in KINDS))).drop(*tmp.values())


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``<KIND>``; of overlapping spans the
    first names the place, and the whole of both goes."""
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        after = F.greatest(acc["pos"], s["end"])
        new = F.array(
            F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]),
            F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")),
        )
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], new)).otherwise(acc["out"])
        return F.struct(after.alias("pos"), out.alias("out"))

    done = F.aggregate(in_order, zero, step)
    whole = F.concat(F.array_join(done["out"], ""), F.substring(text, done["pos"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; same columns. ``n_chars``,
    where there is one, is the new text's length. Null text stays null."""
    cols = docs.columns
    out = with_spans(docs, text, "__pii").withColumn(text, redacted(F.col(f"`{text}`"), F.col("__pii")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.char_length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in cols))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, all spans and their scores per document."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter(F.col("pii"), lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(F.col("pii"), lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(sp.joined(base), 256).alias("base_sha256"),
        sp.joined(F.col("pii")).alias("spans"),
        count("iban").alias("n_iban"),
        F.array_join(F.transform(F.col("pii"), lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
