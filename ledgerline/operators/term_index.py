"""A positional index of English texts kept as Parquet by term: a search reads the folders of its own terms only.

Positions count all words, those without meaning too, so that phrases keep their distances. Postings are built where the texts are read:
each task turns a part of its texts after the other into blocks, a term's postings in that part, and writes them by folder, so nothing
is shuffled and nothing of a frequent term meets in one task. A task leaves a file in each folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import run_dir
from ..functions.stems import porter2
from . import text

FOLDERS = 64
#: Words of texts that make a part.
PART_WORDS = 1 << 20


@dataclass(frozen=True)
class TermIndex:
    """The folder of (term, hits: (key, tf, positions, words) each), by `folder`, the hash of the term. The folder behind the last one has the
    keys of all texts with postings, without a term."""

    path: str
    folders: int

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(term, key, tf, positions, words) of the terms; a key comes once for each of its parts."""
        rows = spark.read.parquet(self.path)
        if not terms:
            return rows.limit(0).select("term", F.inline("hits"))
        where = spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term")).select(folder_of(self.folders).alias("f")).distinct().collect()  # as many as terms
        return rows.where(F.col("folder").isin(*[r.f for r in where]) & F.col("term").isin(*terms)).select("term", F.inline("hits"))

    def whole_postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """The same with the parts of a key as one, by key, so that terms meet on their keys where they are."""
        rows = self.postings(spark, terms).repartition("key").groupBy("term", "key")
        return rows.agg(F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("words").alias("words"))

    def documents(self, spark: SparkSession) -> int:
        """How many keys have postings."""
        return spark.read.parquet(self.path).where(F.col("folder") == self.folders).select(F.inline("hits")).select("key").distinct().count()


def folder_of(folders: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int")


def blocks(part: pa.RecordBatch, hits: pa.ListType) -> pa.RecordBatch:
    """(term, hits) of the texts (key, tokens), a row for each term, its hits in the order of the texts; and one without a term, whose hits
    are the keys of all texts with postings."""
    tokens = part.column("tokens")
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    known = words.dictionary.to_pylist()
    stem_of = [None if w in text.STOP_WORDS else porter2(w) for w in known]
    terms = sorted({t for t in stem_of if t is not None})
    place = {t: i for i, t in enumerate(terms)}
    codes = np.array([-1 if t is None else place[t] for t in stem_of], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.flatnonzero(codes >= 0)
    order = order[np.argsort(codes[order], kind="stable")]  # by term, text and position
    code, doc = codes[order], text_of[order]
    first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(doc, prepend=-1))  # of each posting
    tf = np.diff(first, append=len(order))
    all_docs = np.unique(doc)
    of_term = np.searchsorted(code[first], np.arange(len(terms) + 1))
    docs = np.concatenate((doc[first], all_docs))
    fields = hits.value_type
    lists = np.concatenate((first, [len(order)] * (len(all_docs) + 1))).astype(np.int32)
    columns = {
        "key": part.column("key").take(pa.array(docs)), "tf": pa.array(np.concatenate((tf, 0 * all_docs)), pa.int32()),
        "positions": pa.ListArray.from_arrays(pa.array(lists), pa.array(position[order].astype(np.int32))), "words": pa.array(sizes[docs], pa.int32()),
    }
    rows = pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in fields], fields=list(fields))
    ends = np.append(of_term, len(docs)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.ListArray.from_arrays(pa.array(ends), rows).cast(hits)], ["term", "hits"])


def build_index(docs: DataFrame, key: str, content: str, folders: int = FOLDERS) -> TermIndex:
    """Index (key, content) rows. Null and empty texts have no terms; rows with one key are parts of one document, each with its own
    positions, so keys should be unique; words of STOP_WORDS have places but no postings."""
    words = docs.select(F.col(key).alias("key"), text.tokens(F.col(content)).alias("tokens")).where("key is not null")
    hit = T.StructType([T.StructField("key", words.schema["key"].dataType), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("words", T.IntegerType())])
    index = TermIndex(run_dir(docs.sparkSession, "terms"), folders)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field("key").type
            hits = pa.list_(pa.struct([("key", key_type), ("tf", pa.int32()), ("positions", pa.list_(pa.int32())), ("words", pa.int32())]))
            ends = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_WORDS, side="right")))
                yield blocks(batch.slice(start, stop - start), hits)
                start = stop

    posted = words.mapInArrow(work, T.StructType([T.StructField("term", T.StringType()), T.StructField("hits", T.ArrayType(hit))]))
    posted = posted.withColumn("folder", F.when(F.col("term").isNull(), folders).otherwise(folder_of(folders)))
    # in a folder by term, so that a file's statistics leave out what a search doesn't ask for
    posted.sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(index.path)
    return index


def query_words(query: str) -> list[tuple[int, str]]:
    """(place, stem) of a query's words, without those that mean nothing."""
    spark = SparkSession.active()
    words = spark.range(1).select(text.tokens(F.lit(query)).alias("t")).first()["t"]
    return [(i, porter2(w)) for i, w in enumerate(words) if w not in text.STOP_WORDS]


def search(spark: SparkSession, index: TermIndex, query: str) -> DataFrame:
    """(key, score) of documents with all terms of the query: the sum of ln(1 + tf) * ln(1 + documents / documents with the term), by the
    root of the document's length. A query of stop words finds nothing."""
    terms = sorted({t for _, t in query_words(query)})
    hits = index.whole_postings(spark, terms)
    total = index.documents(spark)
    with_term = hits.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    part = F.log1p("tf") * F.log1p(F.lit(float(total)) / F.col("docs"))
    found = hits.join(F.broadcast(with_term), "term").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("s"), F.max("words").alias("words"))
    return found.where(F.col("n") == len(terms)).where(F.lit(bool(terms))).select("key", (F.col("s") / F.sqrt("words")).alias("score"))


def phrase(spark: SparkSession, index: TermIndex, query: str) -> DataFrame:
    """(key, times) of documents that hold the query's words at the query's distances. Lists of positions are moved back by the word's
    place in the query and cut with each other, so only documents with all words meet."""
    words = query_words(query)
    hits = index.whole_postings(spark, sorted({t for _, t in words}))
    if not words:
        return hits.select("key", F.lit(0).alias("times"))
    lists = [hits.where(F.col("term") == t).select("key", F.expr(f"transform(positions, p -> p - {i})").alias(f"at_{k}")) for k, (i, t) in enumerate(words)]
    met = reduce(lambda a, b: a.join(b, "key"), lists)
    starts = reduce(F.array_intersect, [F.col(f"at_{k}") for k in range(len(words))])
    return met.select("key", F.size(starts).alias("times")).where("times > 0")
