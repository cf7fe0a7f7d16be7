"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwarden.llm import bpe, importance, inner_products, matroska, packing, repeats, secrets, simhash, toxicity, warc
from docwarden.llm.base import table


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every document is muxed to a file first."""
    return matroska.document_packets(table(spark, sf_dir, "documents"))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_check(table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.distinct_pages(table(spark, sf_dir, "pages"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the vectors whose id 20 divides, against all vectors."""
    return inner_products.top_inner_products(table(spark, sf_dir, "embeddings"), every=20)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing,
        op2_matroska_packets,
        op3_byte_level_bpe,
        op4_warc_index,
        op5_exact_top_k,
        op6_secret_scan,
        op7_simhash_near_dedup,
        op8_importance_resampling,
        op9_suffix_array_dedup,
        op10_toxicity,
    )
}

ORACLE_SQL = {
    "op4_warc_index": """
select page_id, trim(regexp_replace(url, '[\\r\\n]+', '', 'g'), ' ' || chr(9)) as url, strlen(html)::bigint as n_bytes, md5(html) as html_md5
from pages where page_id is not null and html is not null
qualify row_number() over (partition by md5(html) order by page_id) = 1
""",
    "op5_exact_top_k": """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0),
pairs as (
  select a.vec_id as query_id, b.vec_id, round(list_inner_product(a.e, b.e), 6) + 0.0 as score
  from v a join v b on a.vec_id <> b.vec_id
  where a.vec_id % 20 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
from pairs qualify rank <= 10
""",
    "op9_suffix_array_dedup": r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') as ws from documents
), grams as (
  select doc_id, p, md5(array_to_string(ws[p + 1:p + 50], ' ')) as gram
  from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as p from words where len(ws) >= 50)
), ranked as (
  select *, row_number() over (partition by gram order by doc_id, p) as nth, count(*) over (partition by gram) as n from grams
), covered as (
  select doc_id, word, bool_or(nth = 1) as kept
  from (select doc_id, nth, unnest(range(p, p + 50)) as word from ranked where n > 1) group by all
), islands as (
  select *, word - row_number() over (partition by doc_id, kept order by word) as island from covered
)
select doc_id, min(word) as start_word, max(word) + 1 as end_word, not kept as is_cut
from islands group by doc_id, kept, island
""",
}
