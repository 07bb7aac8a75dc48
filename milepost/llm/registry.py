"""Queries opN_<name> over the whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from milepost.llm import (
    bpe,
    collocations,
    crf,
    fingerprint,
    html_text,
    jaccard,
    packed,
    packing,
    pii,
    secrets,
    spelling,
    substring,
    topk,
)
from milepost.llm.tokens import tokenizer_path
from milepost.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed-ids")
    packed.write(_docs(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return packed.read_index(spark, path)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


LLM_QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_secrets": lambda spark, d: secrets.report(_docs(spark, d)),
    "op8_packing": op8_packing,
    "op9_packed_ids": op9_packed_ids,
    "op10_bpe": op10_bpe,
    "pipeline": corpus_pipeline.run,
    "op3_substring_dedup": lambda spark, d: substring.report(_docs(spark, d)),
    "op4_jaccard_join": lambda spark, d: jaccard.report(_docs(spark, d)),
    "op5_order_minhash": lambda spark, d: fingerprint.report(_docs(spark, d)),
    "op6_topk": op6_topk,
    "op7_pii": lambda spark, d: pii.report(_docs(spark, d)),
    "op11_spelling": lambda spark, d: spelling.variants(_docs(spark, d)),
    "op12_html": lambda spark, d: html_text.report(spark.read.parquet(f"{d}/pages.parquet")),
    "op13_collocations": lambda spark, d: collocations.collocations(_docs(spark, d)),
}
LLM_ORACLES: dict[str, str] = {
    "op6_topk": """
        with v as (
            select vec_id, [floor(256 * x::double) for x in embedding] e from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
        ),
        s as (
            select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 5
    """,
    "op3_substring_dedup": r"""
        with d as (
            select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents
        ),
        windows as (select r, i, array_to_string(ws[i:i + 34], ' ') s from (select r, ws, unnest(range(1, len(ws) - 33)) i from d)),
        twice as (select s from windows group by s having count(*) > 1),
        gone as (select distinct r, i + k place from windows join twice using (s), range(35) ks(k)),
        words as (select r, unnest(range(1, len(ws) + 1)) place, unnest(ws) word from d),
        kept as (
            select r, string_agg(word, ' ' order by place) kept, count(*) n
            from words anti join gone using (r, place) group by r
        )
        select doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed,
               sha256(coalesce(kept, '')) kept_sha256
        from d left join kept using (r)
    """,
    "op4_jaccard_join": r"""
        with recursive d as (
            select row_number() over () r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') ws
            from documents
        ),
        shingles as (
            select distinct r, array_to_string(ws[i:i + 4], ' ') s
            from (select r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from d where len(ws) > 0)
        ),
        sizes as (select r, count(*) n from shingles group by r),
        common as (
            select a.r x, b.r y, count(*) c from shingles a join shingles b on a.s = b.s and a.r <> b.r group by a.r, b.r
        ),
        links as (
            select x, y from common join sizes p on p.r = x join sizes q on q.r = y where 100 * c >= 75 * (p.n + q.n - c)
        ),
        reached as (select r, r o from d union select reached.r, links.y from reached join links on reached.o = links.x),
        least_id as (select reached.r, min(doc_id) component_id from reached join d on d.r = reached.o group by reached.r)
        select doc_id, coalesce(n, 0)::bigint n_shingles, component_id
        from d join least_id using (r) left join sizes using (r)
    """,
    "op13_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') lang, row_number() over () doc, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
            from documents where text is not null
        ),
        split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from pieces),
        grams as (
            select lang, size, array_to_string(ws[i:i + size - 1], ' ') phrase, count(*) a
            from (select lang, ws, unnest(range(1, len(ws) + 1)) i from split), range(1, 6) sizes(size)
            where i + size - 1 <= len(ws) group by all
        ),
        totals as (select lang, sum(a)::hugeint n from grams where size = 1 group by lang),
        often as (select lang, size, phrase, a, string_split(phrase, ' ') ws from grams where a >= 100),
        cuts as (select lang, size, phrase, a, ws, unnest(range(1, size)) k from often where size > 1),
        valued as (
            select c.lang, c.phrase, c.a, c.k, x.a l, y.a r, t.n,
                   (1000 * c.a::hugeint * t.n) // (x.a::hugeint * y.a) score
            from cuts c join totals t using (lang)
            join often x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:c.k], ' ')
            join often y on y.lang = c.lang and y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
        ),
        weakest as (
            select * from valued qualify row_number() over (partition by lang, phrase order by score, k) = 1
        ),
        inner_ones as (
            select distinct o.lang, array_to_string(o.ws[b:e], ' ') phrase, o.a
            from often o, range(1, 5) bs(b), range(2, 6) es(e)
            where e <= o.size and e > b and e - b + 1 < o.size
        ),
        kept as (
            select * from weakest w where not exists (
                select 1 from inner_ones i where i.lang = w.lang and i.phrase = w.phrase and i.a >= w.a)
        ),
        placed as (
            select *, row_number() over (partition by lang order by score desc, a desc, phrase) "rank" from kept
        )
        select lang, "rank"::bigint "rank", phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n,
               score::bigint score
        from placed where "rank" <= 2000
    """,
}
