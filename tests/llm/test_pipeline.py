"""The pipeline's stages on a small planted table, each against plain Python."""

import random
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from milepost.llm import crf, substring
from milepost.llm.tokens import tokenizer_path
from tests.llm.helpers import words
from tests.llm.test_pairs import WORD, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = tokenizer_path("word_bpe_49k.json")


def planted():
    """Good and junk lines, near copies, a shared passage, personal data, odd rows."""
    rng = random.Random(21)

    def prose(n):
        return " ".join(" ".join(words(rng, 9, "abcdefghijklmnop", 7)).capitalize() + "." for _ in range(n))

    base, passage = prose(9), " ".join(words(rng, 60, "qrstuv", 6))
    near = base.split()
    near[40] = "changed"
    rows = [
        prose(8),
        base,
        " ".join(near),
        base,
        prose(5) + "\n" + passage + "\n" + prose(4),
        prose(6) + " " + passage,
        prose(3) + " write to jo.doe@mail.example.org or call +49 30 1234567, host 10.1.2.3.",
        prose(4) + " card 4111 1111 1111 1111 and no more",
        "@@@ ### $$$ %%%\n" * 30,
        "!!!! ???? 0000 ----\n" * 25,
        "",
        None,
        prose(200),
    ]
    rows = [(i * 2, t) for i, t in enumerate(rows)] + [(2, base), (2, prose(7)), (None, prose(5)), (None, base)]
    rows += [(100 + i, prose(6)) for i in range(12)] + [(200 + i, "$$$ @@@ ~~~ \n" * (5 + i)) for i in range(12)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_stages_against_plain_python(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = [(100 + i, 1, 0) for i in range(12)] + [(200 + i, 0, 0) for i in range(12)] + [(0, 1, 0), (16, 0, 0), (18, 0, 0)]
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "substring dedup", "PII", "best-fit packing"]

    # 1: the documents whose own score, one text at a time, reaches the threshold.
    model = crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [r for r in rows if crf.document_scores([r[1] or ""], model)[0] >= crf.THRESHOLD]
    junk = {r[0] for r in rows} - {r[0] for r in kept}
    assert junk >= {16, 18, *range(200, 212)} and not junk & {0, 2, 4, 6, 8, 10, 12, 14, 24, None, *range(100, 112)}
    good = stages["quality classifier"](spark, docs, sf)
    assert good.columns == docs.columns and key(good.collect()) == key(kept)
    good.write.parquet(f"{sf}/1")
    good = spark.read.parquet(f"{sf}/1")

    # 2: one row of each component, the one with the smallest id; rows without words all.
    wordless = [r for r in kept if not WORD.findall(r[1] or "")]
    full = [r for r in kept if WORD.findall(r[1] or "")]
    one = {}
    numbered = [(n, r[1]) for n, r in enumerate(full)]  # components by row number, as ids repeat
    component = {int(n): int(c) for n, _, c in brute_components(numbered)}
    for n, r in enumerate(full):
        held = one.get(component[n])
        if held is None or (r[0] is None, r[0] or 0) < (held[0] is None, held[0] or 0):
            one[component[n]] = r
    kept = [*one.values(), *wordless]
    apart = stages["n-gram Jaccard join"](spark, good, sf)
    assert apart.columns == docs.columns and key(apart.collect()) == key(kept)
    assert Counter(r[0] for r in kept)[2] == 2  # the two rows of id 2 are different texts
    apart.write.parquet(f"{sf}/2")
    apart = spark.read.parquet(f"{sf}/2")

    # 3: words under windows that start elsewhere, too, go.
    split = [WORD.findall(r[1] or "") for r in kept]
    size = substring.WINDOW
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    left = []
    for r, w in zip(kept, split):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        text = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r[1]
        left.append((r[0], text, *r[2:4], len(text) if any(gone) else r[4]))
    assert sum(a[1] != b[1] for a, b in zip(left, kept)) == 2  # the passage of ids 8 and 10
    passages = stages["substring dedup"](spark, apart, sf)
    assert passages.columns == docs.columns and key(passages.collect()) == key(left)
    passages.write.parquet(f"{sf}/3")
    passages = spark.read.parquet(f"{sf}/3")

    # 4: personal data gives way to its kind.
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>"),
        (r"10\.1\.2\.3", "<IP>"),
        (r"4111 1111 1111 1111", "<CARD>"),
        (r"\+49 30 1234567", "<PHONE>"),
    ]
    clean = []
    for r in left:
        text = r[1]
        for pattern, name in rules if text else ():
            text = re.sub(pattern, name, text)
        clean.append((r[0], text, *r[2:4], r[4] if text is None else len(text)))
    assert sum("<" in (r[1] or "") for r in clean) == 2
    redacted = stages["PII"](spark, passages, sf)
    assert redacted.columns == docs.columns and key(redacted.collect()) == key(clean)
    redacted.write.parquet(f"{sf}/4")
    redacted = spark.read.parquet(f"{sf}/4")

    # 5: the library's ids and the end id, in pieces that fill sequences without gaps.
    whole = Tokenizer.from_file(WORDS)
    pieces = []
    for r in clean:
        n = len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1
        pieces += [(r[0], at // 4096, at, min(4096, n - at)) for at in range(0, n, 4096)]

    def check(out):
        assert key((r.doc_id, r.piece, r.start, r.length) for r in out) == key(pieces)
        by = {}
        for r in out:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            ends = [0]
            for offset, length in sorted(places):
                assert offset == ends[-1]
                ends.append(offset + length)
            assert ends[-1] <= 4096
        assert len(by) <= -(-sum(p[3] for p in pieces) // 4096) + 1

    check(stages["best-fit packing"](spark, redacted, sf).collect())
    check(corpus_pipeline.run(spark, sf).collect())  # all stages, written and read again
