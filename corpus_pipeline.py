"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it again as the next stage's documents. All but the last return the columns
of documents.

All stages take documents with any other columns, whatever their names (dots among them), null texts, sources and ids, repeated rows and
texts of any length, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, mixing, ngram_join, repetition, token_store
from ledgerline.llm.common import run_dir, written
from ledgerline.session import importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null and empty texts have no words and go; repeated rows stay or go together."""
    importable(spark)
    return repetition.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Texts without words and rows without an id are in no group
    and stay; rows that share a doc_id stay or go together."""
    importable(spark)
    return ngram_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go. Null and empty texts stay as they are; repeated rows are
    cut alike; items without an id or a text are none."""
    importable(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight, a row per copy. A null source is the last source; texts without words are not taken; rows that repeat
    are taken one by one."""
    importable(spark)
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; (doc_id, start, n_tokens, ids_crc32) as read back from them. A null text is empty; rows of one doc_id, the
    copies of the mix, are written each, in the order of their texts' hashes; rows without an id come first."""
    import public_tokenizers

    importable(spark)
    folder = run_dir(spark, "tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    # workers serve all stages beside a JVM that others have filled: this one remembers little and leaves nothing in them
    written(token_store.write_tokens(docs, folder, path, room=60_000, keep=False, roll_bytes=16 << 20, segment_ids=1 << 19), "token-manifest")
    return token_store.token_report(spark, folder)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed_sources),
    ("token_files", token_files),
]

#: No stage but the second is expressible in SQL: tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
