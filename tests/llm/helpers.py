"""Small documents with the cases every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, spans int, row int"


def words(rng, n, alphabet="abcdefgh", size=3):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(n)]


def texts(seed=7):
    """Fresh, copied, edited, short, blank and odd texts; None for a null."""
    rng = random.Random(seed)
    base = words(rng, 120)
    other = words(rng, 90)
    edited = list(base)
    edited[60] = "changed"
    far = list(base)
    for k in range(0, 120, 9):
        far[k] = "x" + far[k]
    passage = words(rng, 45)
    return [
        " ".join(base),
        " ".join(base),
        " ".join(base).upper(),
        " ".join(edited),
        " ".join(far),
        " ".join(other),
        " ".join(words(rng, 30) + passage + words(rng, 30)),
        "\n".join(words(rng, 10) + passage),
        " ".join(passage[:35]),
        " ".join(passage[1:35]),
        "one two three",
        "one two three",
        "one two three four five",
        "word",
        "",
        " \t\n ",
        None,
        "a " * 300,
        "b a " * 200,
        "naïve été x 日本 😀 " * 8,
        "\n\n\n",
        " ".join(words(rng, 5000, size=6)),
    ]


def documents(spark, more=()):
    """``texts`` with ids, a repeated row, a null id and extra columns of clashing names."""
    rows = [(i * 3, t) for i, t in enumerate(texts())] + list(more)
    rows += [rows[0], (None, "no id here"), (None, None)]
    full = [(i, t, None, "s", None if t is None else len(t), "old", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    """(doc_id, text) of all rows; null text as ''."""
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
