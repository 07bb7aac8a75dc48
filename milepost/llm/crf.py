"""Quality classifier (operator 1): a linear-chain conditional random field.

Every line is labelled good or bad from its own features and those of the
lines before and after it. Forward-backward gives each line's probability of
being good; their mean, weighted by line length, is the document's score.

Training takes at most ``sample`` labelled documents (a documented bound): the
least by a hash of their id among those not held out; of a document that has more
than ``LINES`` lines, so many in a row from a place by its id's hash, in chains
of ``CHAIN`` lines. A line's label is its document's. Features are computed on the
executors; the driver gets the sample's feature rows, so ``sample * LINES`` at most,
and fits a few dozen weights. Scores take all lines of all documents.

Defined results: null or empty text is one empty line and has a score like any
other; repeated rows get equal scores; a label that is null is not used, of
several labels of one document the greatest counts, and of several texts of one
id training takes the one of least hash; without any label of one
of the two classes every score is the share of good labels (1 if there are no
labels); labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.llm.words import slices
from milepost.session import ship_package

SAMPLE = 3000
#: Lines of a document in training.
LINES = 512
#: Lines of a chain in training; longer documents are several chains.
CHAIN = 64
STEPS = 250
RATE = 0.1
L2 = 1e-3

OTHER, LOWER, UPPER, DIGIT, BLANK, STOP, SYMBOL, BREAK = range(8)


def _classes() -> np.ndarray:
    """Class of each code point below U+0250; all beyond are OTHER."""
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if ch == "\n":
            table[c] = BREAK
        elif ch.isspace():
            table[c] = BLANK
        elif ch.isdigit():
            table[c] = DIGIT
        elif ch.isupper():
            table[c] = UPPER
        elif ch.isalpha():
            table[c] = LOWER
        elif ch in ".,;:'\"?()-":
            table[c] = STOP
        else:
            table[c] = SYMBOL
    return table


_TABLE = _classes()
FEATURES = 10
#: Divides the logarithm of a line's length, the first feature.
SIZE_SCALE = 8


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines (rows), the lines' weights, and each text's first line (and the end)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER)
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    # Lines of each text: one more than its line breaks.
    counts = np.array([t.count("\n") + 1 for t in texts])
    first = np.concatenate([[0], np.cumsum(counts)])

    share = np.maximum(size, 1)
    cum = np.zeros(len(points) + 1)

    def per_line(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, out=cum[1:])
        return cum[ends] - cum[starts]

    by_kind = {k: per_line(kind == k) for k in (OTHER, UPPER, DIGIT, BLANK, STOP, SYMBOL)}
    # Words: runs of neither blanks nor breaks, told apart by a hash.
    solid = (kind != BLANK) & (kind != BREAK)
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    n_words = repeats = np.zeros(len(ends))
    if len(begins):
        n_words = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
        at = np.arange(len(points), dtype=np.uint64)
        owner = np.maximum(np.cumsum(np.isin(np.arange(len(points)), begins, assume_unique=True)) - 1, 0)
        place = (at - begins[owner].astype(np.uint64)) & np.uint64(0xFF)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        word = np.add.reduceat(np.where(solid, mixed, np.uint64(0)), begins)
        line = np.searchsorted(ends, begins)
        again = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
        repeats = np.bincount(line[1:][again], minlength=len(ends)).astype(np.float64)
    words = np.maximum(n_words, 1)
    own = np.stack(
        [
            np.log1p(size) / SIZE_SCALE,
            by_kind[UPPER] / share,
            by_kind[DIGIT] / share,
            by_kind[STOP] / share,
            by_kind[SYMBOL] / share * 4,
            by_kind[OTHER] / share,
            np.minimum((size - by_kind[BLANK]) / words, 20) / 20,
            by_kind[SYMBOL] / words,
            repeats / words,
            (size == 0).astype(np.float64),
        ],
        axis=1,
    )
    return own, size + 1, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bias, own features, and the features of the line before and after (zeros at a text's ends)."""
    before = np.zeros_like(own)
    after = np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after], axis=1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of a line being good
    step: np.ndarray  # 2 x 2: score of going from one label to the next
    scale: tuple[float, float] = (1.0, 0.0)  # of a document's log-odds, and what is added
    constant: float | None = None  # the score of every document, where there was nothing to learn


def marginals(good: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each line being good, and the expected label pairs summed per chain.

    Chains are worked on side by side, the longest first, one line of each at a
    time; probabilities are scaled at every line, so no chain is too long.
    """
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    lengths, heads = n_lines[order], first[:-1][order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    move = np.exp(step - step.max())
    odds = 1 / (1 + np.exp(-np.clip(good, -30, 30)))
    emit = np.stack([1 - odds, odds], axis=1)
    forward = np.empty((len(good), 2))
    for t in range(longest):
        at = heads[: active[t]] + t
        f = emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    backward = np.ones((len(good), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = heads[: active[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1]
        both = forward[at][:, :, None] * move[None] * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ move.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


def fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray, first: np.ndarray) -> Model:
    """Weights of greatest likelihood under an L2 penalty (Adam, full batches)."""
    chains = np.concatenate([np.arange(a, z, CHAIN) for a, z in zip(first[:-1], first[1:])] + [first[-1:]])
    inner = np.ones(len(x), bool)
    inner[chains[:-1]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (label[at - 1], label[at]), 1)
    theta = np.zeros(x.shape[1] + 4)
    m = np.zeros_like(theta)
    v = np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        weights, step = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = marginals(x @ weights, step, chains)
        grad = np.concatenate([x.T @ (p - label), (pairs - seen).ravel()]) / len(x) + L2 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights, step = theta[:-4], theta[-4:].reshape(2, 2)
    return Model(weights, step, _calibrated(x, label, weight, first, weights, step))


def _log_odds(p: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the documents' mean probability, weighted by line length."""
    mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    mean = np.clip(mean, 1e-9, 1 - 1e-9)
    return np.log(mean / (1 - mean))


def _calibrated(x, label, weight, first, weights, step) -> tuple[float, float]:
    """Logistic scale of the documents' log-odds: the share of good documents
    among those of like score (Newton's method with a slight ridge)."""
    odds = _log_odds(marginals(x @ weights, step, first)[0], weight, first)
    design = np.stack([odds, np.ones(len(odds))], axis=1)
    good = label[first[:-1]]
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        theta = theta - np.linalg.solve(hessian, design.T @ (p - good) + theta - [1.0, 0.0])
    return max(float(theta[0]), 1e-3), float(theta[1])


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out."""
    known = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    ship_package(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own, _, first = line_features(b.column("text").to_pylist())
            rows = []
            for i, a, z in zip(b.column("doc_id").to_pylist(), first[:-1], first[1:]):
                begin = a + zlib.crc32(str(i).encode()) % max(1, z - a - LINES + 1)
                rows.append(own[begin : min(z, begin + LINES)].ravel())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "quality", "own"],
            )

    # The sample's ids are bounded, so this side may be broadcast. One text per id.
    found = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality")
    chosen = found.agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    got = sorted(
        ((r.doc_id, r.quality, r.own) for r in chosen.mapInArrow(run, f"doc_id {kind}, quality int, own array<double>").collect()),
        key=lambda r: (r[0], len(r[2]), r[2][:8]),
    )
    quality = np.array([int(q > 0) for _, q, _ in got])
    if not len(quality) or quality.min() == quality.max():
        return Model(np.zeros(0), np.zeros((2, 2)), constant=float(quality.mean()) if len(quality) else 1.0)
    own = [np.array(o).reshape(-1, FEATURES) for *_, o in got]
    first = np.concatenate([[0], np.cumsum([len(o) for o in own])])
    lines = np.concatenate(own)
    weight = np.expm1(lines[:, 0] * SIZE_SCALE) + 1
    return fit(with_neighbours(lines, first), np.repeat(quality, np.diff(first)), weight, first)


def document_scores(texts: list[str], model: Model) -> np.ndarray:
    """0 to 1 per text; higher: label 1 likelier."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    own, weight, first = line_features(texts)
    p, _ = marginals(with_neighbours(own, first) @ model.weights, model.step, first)
    scale, shift = model.scale
    return 1 / (1 + np.exp(-np.clip(scale * _log_odds(p, weight, first) + shift, -500, 500)))


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` plus the score (in place of a column of that name); a map over the rows."""
    ship_package(docs.sparkSession)
    cols = [c for c in docs.columns if c != out]
    body = docs.select(*(f"`{c}`" for c in cols), F.coalesce(F.col("text"), F.lit("")).alias("__body"))
    schema = docs.select(*(f"`{c}`" for c in cols)).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__body"):
            scores = document_scores(b.column(b.num_columns - 1).to_pylist(), model)
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*cols, out])

    return body.mapInArrow(run, schema)


#: A document with at least this score counts as good.
THRESHOLD = 0.3


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
