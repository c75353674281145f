"""Queries of the vector index and of the term index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import table
from ..operators import term_index, vectors
from .registry import query


@query("""
    with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
    s as (select q.vec_id as query, v.vec_id as key, list_cosine_similarity(q.e, v.e) as score from v q join v on true where q.vec_id % 100 = 0)
    select query, key, round(score, 5) as score, cast(rank as int) as rank from (select *, row_number() over (partition by query order by score desc, key) as rank from s) where rank <= 10""")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.search_each(vectors.build_index(rows), rows.where("vec_id % 100 = 0"), 10, probes=None)
    return found.select("query", "key", F.round("score", 5).alias("score"), "rank")


@query()
def vector_neighbours_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the lists; the test holds what it finds against all of them."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.build_index(rows)
    return vectors.search_each(index, rows.where("vec_id % 100 = 0"), 10, probes=max(1, len(index.centroids) * 2 // 3))


@query("""
    with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents),
    hit as (select doc_id, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'apache' and ws[i + 1] in ('license', 'licensed', 'licenses', 'licensing') and ws[i + 2] in ('version', 'versions', 'versioned'))) as times from w)
    select doc_id, cast(times as int) as times from hit where times > 0""")
def phrase_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = term_index.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return term_index.phrase(spark, index, "Apache Licenses, versioned").withColumnRenamed("key", "doc_id")


@query("""
    with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents),
    n as (select doc_id, ws, len(list_filter(ws, lambda x: x in ('license', 'licensed', 'licenses', 'licensing'))) as a, len(list_filter(ws, lambda x: x in ('version', 'versions', 'versioned'))) as b from w),
    t as (select count(*) filter (where len(list_filter(ws, lambda x: x not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'will', 'with'))) > 0) as docs, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db from n)
    select doc_id, round((ln(1 + a) * ln(1 + docs / da) + ln(1 + b) * ln(1 + docs / db)) / sqrt(len(ws)), 6) as score from n, t where a > 0 and b > 0""")
def term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = term_index.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return term_index.search(spark, index, "the licensing of versions").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
