"""Operators 1, 3, 4, 6 and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from milepost.llm import crf, jaccard, substring, topk
from milepost.llm.registry import LLM_QUERIES
from tests.llm.helpers import documents, empty, pairs, words

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def brute_removed(docs, window):
    """Per row: words, removed words, kept words."""
    split = [(i, WORD.findall(t)) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    docs = documents(spark)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(docs).collect()]
    assert sorted(got) == brute_removed(pairs(docs), 35)
    assert substring.report(empty(spark)).count() == 0
    out = substring.removed(docs)
    assert out.columns == docs.columns
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by_id[0].text == "" and by_id[0].n_chars == 0 and by_id[48].text is None and by_id[0].score == "old"
    assert by_id[15].text == dict(pairs(docs))[15]


def test_substring_dedup_of_a_tiny_alphabet(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randint(0, 60), "ab", 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring.deduplicated(df, window=9, gram=3).collect()
    got = [(str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out]
    assert sorted(got) == brute_removed(rows, 9)


@pytest.mark.parametrize("often", [1000, 2])
def test_substring_dedup_with_frequent_keys(spark, monkeypatch, often):
    """Copies of rows, of null ids and of a passage, also as keys that are spread."""
    monkeypatch.setattr(substring, "OFTEN", often)
    rng = random.Random(often)
    passage = words(rng, 45)
    same = " ".join(words(rng, 50))
    rows = [(1, same)] * 12 + [(None, same)] * 8 + [(None, " ".join(words(rng, 20) + passage + words(rng, 20))) for _ in range(9)]
    rows += [(100 + i, " ".join(words(rng, rng.randint(0, 30)) + passage + words(rng, 5))) for i in range(15)]
    rows += [(200, " ".join(passage)), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(df).collect()]
    assert sorted(got) == brute_removed([(i, t or "") for i, t in rows], 35)


def test_factors_are_greedy_and_refer_to_equal_words(spark, tmp_path):
    """Factors: start, length and reference, the words there are equal, and a factor
    could not have begun where the one before it ends and go on with it."""
    rng = random.Random(12)
    parts = [words(rng, 60) for _ in range(4)]
    texts = [sum(parts, []), parts[1] + words(rng, 9) + parts[3] + parts[0], words(rng, 50), parts[2] + parts[3]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    keyed = substring._rows(df, "doc_id")
    listed = substring.blocks(keyed)
    listed.write.parquet(f"{tmp_path}/blocks")
    listed = spark.read.schema(substring.BLOCKS).parquet(f"{tmp_path}/blocks")
    substring._shared(listed, str(tmp_path)).write.parquet(f"{tmp_path}/shared")
    shared = spark.read.schema(substring.SHARED).parquet(f"{tmp_path}/shared")
    names = {r["__row"]: r.doc_id for r in keyed.collect()}
    found = {names[r.row]: r for r in substring.parse(shared, str(tmp_path)).collect()}
    assert 2 not in found and len(found) == 3
    long_factors = 0
    for i, r in found.items():
        for start, length, ref, at in zip(r.starts, r.lengths, r.ref_rows, r.ref_starts):
            assert length >= substring.WINDOW
            assert texts[i][start : start + length] == texts[names[ref]][at : at + length]
            long_factors += length > substring.WINDOW + 8
        assert all(a < b for a, b in zip(r.starts, r.starts[1:]))
    assert long_factors >= 2


def brute_components(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    named = [least.get(g) if s else i for (i, _), g, s in zip(rows, label, sets)]
    return sorted((str(i), len(s), str(c)) for (i, _), s, c in zip(rows, sets, named))


def components(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.report(df).collect())


def test_jaccard_join(spark):
    docs = documents(spark)
    assert components(docs) == brute_components(pairs(docs))
    assert jaccard.report(empty(spark)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    named = {(r.doc_id, r.n_shingles) for r in jaccard.report(docs).filter("doc_id = component_id").collect()}
    assert ids == sorted(i for i, _ in named)


def test_jaccard_join_of_a_crowd(spark):
    """Near copies around the threshold, chains, and a passage that all share."""
    rng = random.Random(4)
    rows = []
    base = words(rng, 100, size=5)
    shared = words(rng, 30, size=5)
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = words(rng, 80, size=5)
    for i in range(70, 110):
        chain = chain[3:] + words(rng, 3, size=5)
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(words(rng, 40, size=5) + shared + words(rng, 40, size=5))) for i in range(110, 170)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(df) == brute_components(rows)


def test_jaccard_join_loses_no_borderline_link(spark):
    """Pairs with 6 of 8 shingles in common that share none of 120 keys of six of 160 min-hashes."""
    rows = []
    for i in (350305, 429188, 583966):
        w = [f"w{i}x{k}" for k in range(12)]
        rows += [(2 * i, " ".join(w[:11])), (2 * i + 1, " ".join(w[1:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(df) == brute_components(rows)
    assert len({c for _, _, c in components(df)}) == 3


def test_elements_keep_a_set_s_size():
    s = np.array([1, 2, 3, 1 << 16, (1 << 16) + 9, 5 << 16, 2**64 - 2, 2**64 - 1], np.uint64)
    e = jaccard._elements(s, 48)
    assert len(set(e.tolist())) == len(s) and (e >> np.uint64(16)).tolist() == (s >> np.uint64(16)).tolist()
    part = jaccard._elements(s[[1, 2, 3, 7]], 48)
    assert len(set(part.tolist()) & set(e.tolist())) == 4
    assert jaccard.unpacked([jaccard.packed(s[:3]), jaccard.packed(s[3:])]).tolist() == s.tolist()


def test_prefix_keys_of_linking_sets_meet(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        w = words(rng, rng.randint(5, 60), "ab", 2)
        other = list(w)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(w))] = f"n{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {jaccard._set_id(s): set(s.tolist()) for s in jaccard.shingle_sets([t for _, t in rows])}
    keys = {}
    for r in jaccard.prefix_keys(df, 8).collect():
        if r.nth <= jaccard._prefix(r.shared, len(sets[r.set_id])):
            keys.setdefault(r.set_id, set()).add(r.key)
    met = 0
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 100 * len(x & y) >= 75 * len(x | y):
                met += 1
                assert keys[a] & keys[b]
    assert met > 5


def crowd(n, seed):
    """Near copies of one text that link in chains, and some others."""
    rng = random.Random(seed)
    base = words(rng, 60)
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = "x" + str(rng.randrange(40))
        out.append((i, " ".join(w)))
    return out + [(n + i, " ".join(words(rng, 40))) for i in range(20)]


def test_links_of_a_crowd_grow_with_its_documents(spark, monkeypatch):
    """Links between groups are less than groups in each task; components as brute force."""
    made = []
    found = jaccard._matrix_links

    def watched(*args):
        out = found(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_matrix_links", watched)
    for n in (100, 200, 400):
        rows = crowd(n, 5)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.report(df).collect())
        assert got == sorted((str(a), b, str(c)) for a, b, c in brute_components(rows))
    assert made[-1] <= 400 and made[-1] <= 5 * max(made[0], 10)


def test_rows_of_one_id_are_kept_apart(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a), (None, c), (None, c), (None, a), (7, ""), (7, None), (8, " "), (9, b), (9, b)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, c), (7, ""), (7, None), (8, " ")], key=str)


def test_small_tables_are_few_files(spark, monkeypatch, tmp_path):
    """However many partitions a shuffle has: Hadoop starts a process for every local file."""
    rng = random.Random(8)
    texts = [words(rng, 80, "abcdefgh", 3) for _ in range(120)]
    # Copies that differ by a word, and ones that share a passage.
    rows = [(4 * i + k, " ".join([*t[:40], f"w{k}", *t[40:]])) for i, t in enumerate(texts) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for module in (jaccard, substring):
        monkeypatch.setattr(module, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.component_id for r in jaccard.report(df).collect()}
        removed = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(df).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i // 4 * 4 for i, _ in rows}
    assert sorted(removed) == brute_removed(rows, 35)
    files = Counter(str(f.parent.relative_to(tmp_path)) for f in tmp_path.rglob("part-*.parquet"))
    most = spark.sparkContext.defaultParallelism
    small = {f"jaccard/{t}" for t in "classes prefixes keyed sets nearest links groups/edges groups/labels0 areas/next0 shared blocks asked".split()}
    small |= {f"substring/{t}" for t in "index shared contents factors counts repeated".split()}
    assert small <= set(files)
    assert {t: n for t, n in files.items() if t in small and n > most} == {}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 6).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # copies
    rows += [(500, None), (550, [None] * 6), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (None, [1.0] * 6), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4) if False else (
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    )
    good = {i: np.floor(256 * np.array(v, "float32").astype(float)).astype(int) for i, v in rows[:340]}
    want = []
    for q in (i for i in good if i % 50 == 0):
        found = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    few = topk.search(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_top(rows, k=5):
    """As the SQL: all pairs of rows with different ids, ranked by query id."""
    by = {}
    for q, x in rows:
        if q % 50 == 0:
            by.setdefault(q, []).extend((-int(np.dot(x, y)) * 65536, i) for i, y in rows if i != q)
    return sorted((q, n + 1, i, -s) for q, found in by.items() for n, (s, i) in enumerate(sorted(found)[:k]))


def top(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.search(df.repartition(3), F.col("vec_id") % 50 == 0).collect())


def test_top_k_counts_rows_that_repeat(spark):
    rng = np.random.default_rng(5)
    some = [(i, rng.integers(-9, 10, 4).tolist()) for i in range(0, 60)]
    # Copies of one row before another id of the same vector.
    rows = [(1, [30, 0, 0, 0])] * 6 + [(2, [30, 0, 0, 0]), (50, [1, 0, 0, 0]), (50, [1, 0, 0, 0]), (1, [2, 2, 2, 2])]
    assert top(spark, rows) == brute_top(rows)
    # Every row twice.
    assert top(spark, some * 2) == brute_top(some * 2)
    # A query's own id in several of its best classes, and more queries with equal vectors.
    own = [(0, [40 + j, 0, 0, 0]) for j in range(9)] + [(50, [44, 0, 0, 0]), (100, [44, 0, 0, 0]), (7, [44, 0, 0, 0])]
    assert top(spark, some + own) == brute_top(some + own)
    assert len([r for r in top(spark, own) if r[0] == 0]) == 5


def test_top_k_broadcasts_no_blocks(spark, monkeypatch):
    """Vectors and blocks are never sent through the driver, however small Spark takes them to be."""
    plans = []
    write = DataFrameWriter.parquet

    def watched(self, *rest, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *rest, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 8)
    rows = [(i, np.random.default_rng(i).integers(-9, 10, 4).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    found = topk.search(df, F.col("vec_id") % 50 == 0)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, found.collect())) == brute_top(rows)
    assert len(plans) > 4 and not [x for x in plans if "Broadcast" in x]


@pytest.mark.parametrize("least", [1, 1 << 10, 1 << 14])
def test_top_k_over_blocks_and_groups(spark, monkeypatch, least):
    """Several blocks and groups of either side; products beyond what floats hold exactly; unlike lengths."""
    for name, value in (("QUERY_BLOCK", 2), ("VECTOR_BLOCK", 16), ("GROUP", 3), ("CELLS", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(least)
    rows = [(i, (rng.integers(-99, 100, 7) * least + rng.integers(0, 2, 7)).tolist()) for i in range(0, 400, 2)]
    rows += [(i, x) for i, (_, x) in zip(range(1, 60, 2), rows)] + [(450 + 50 * i, rows[i][1]) for i in range(3)] + rows[:9]
    short = [(999, [99 * least]), (1000, [1, 2, 3])]
    whole = [(i, x + [0] * (7 - len(x))) for i, x in rows + short]
    assert top(spark, rows + short) == brute_top(whole)


def test_top_k_scores_beyond_64_bits(spark):
    rows = [(i, [float(1 << 28), float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)beyond 64 bits|overflow"):
        topk.search(df, F.col("vec_id") % 50 == 0).collect()


def test_top_k_drops_only_what_is_behind(spark):
    """What a cell leaves out has k + 1 leads ahead of it; the rest stays."""
    rng = np.random.default_rng(3)
    n, keep = 500, 6
    found = [rng.integers(0, 5, n), rng.permutation(n), rng.integers(0, 9, n), rng.integers(0, 40, n), rng.integers(0, 2, n)]
    kept = topk._foremost([[x[:200] for x in found], [x[200:] for x in found]], keep)
    want = []
    for q in range(5):
        leads = 0
        for row in sorted((-s, i, v, lead) for a, v, s, i, lead in zip(*found) if a == q):
            if leads < keep:
                want.append((q, row[2]))
            leads += row[3]
    assert list(zip(kept[0], kept[1])) == want


def test_quality_of_held_out_documents(spark):
    out = LLM_QUERIES["op1_quality"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    seen = out[out.held_out].merge(labels, on="doc_id")
    assert (seen.predicted == seen.quality).mean() > 0.97
    assert seen[seen.quality == 1].predicted.mean() > 0.99


def test_quality_edges(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in crf.report(docs, none).collect()} == {1.0}
    labels = spark.createDataFrame([(0, 1), (0, 1), (51, 0), (54, 0), (15, 1), (18, None), (None, 1)], "doc_id long, quality int")
    out = crf.report(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert crf.report(empty(spark), labels).count() == 0
    model = crf.train(docs, labels)
    assert crf.with_score(docs, model).columns[-1] == "score"


def test_training_takes_a_bounded_part_of_a_giant_document(spark):
    """One text of an id that occurs often, and LINES of its lines."""
    giant = "\n".join(f"line {i} of a long document." for i in range(5000))
    rows = [(1, giant)] * 200 + [(2, "bad !!! $$$\n" * 3000), (3, "good words in a line."), (4, "@@@ ###")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    sizes = []
    fit = crf.fit

    def watched(lines, *rest):
        sizes.append(len(lines))
        return fit(lines, *rest)

    crf.fit = watched
    try:
        crf.train(docs, labels)
    finally:
        crf.fit = fit
    assert sizes and sizes[0] <= 2 * crf.LINES + 2
    assert len(crf.report(docs, labels).collect()) == len(rows)


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    good, step = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 7])
    p, pairs_ = crf.marginals(good, step, first)
    total = np.zeros((2, 2))
    for a, z in ((0, 4), (4, 7)):
        weight, one, both = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for bits in range(2 ** (z - a)):
            y = [(bits >> k) & 1 for k in range(z - a)]
            w = np.exp(sum(good[a + k] * y[k] for k in range(z - a)) + sum(step[u, v] for u, v in zip(y, y[1:])))
            weight += w
            one += w * np.array(y)
            for u, v in zip(y, y[1:]):
                both[u, v] += w
        assert np.allclose(p[a:z], one / weight)
        total += both / weight
    assert np.allclose(pairs_, total)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = after
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in by.values())
