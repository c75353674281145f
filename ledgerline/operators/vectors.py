"""An inverted-file index over vectors: coarse centroids, every row in the list of its nearest, kept as Parquet by list.

Centroids are fitted on a bounded sample (`sample` rows, by hash); all rows are assigned. A search looks into the lists nearest to the
query only, which are folders, so the rest is never read, and scores their rows exactly. With `probes=None` it looks into all lists and
is exact. Similarity is the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import run_dir
from .text import cosine

#: Centroids at most: they go to every task.
MOST_LISTS = 4096
#: Rows, and queries, that meet in one block, and queries scored at once.
BLOCK, DECK = 8192, 512


@dataclass(frozen=True)
class VectorIndex:
    """Where the lists are, under `path` by their number, and their centroids, one unit vector a row."""

    path: str
    centroids: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")

    def nearest_lists(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The numbers of the `probes` nearest lists of each vector, nearest first."""
        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")[:, :probes]


def spherical_centroids(sample: np.ndarray, lists: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's rounds on unit vectors, from evenly spaced rows of the sample; an empty list starts again at the
    row that is worst served."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        score = sample @ centroids.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(score.max(axis=1))[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    rows = np.array(column.to_pylist(), dtype=float).reshape(-1, dim)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a key and a vector that has no null, no infinity and some length."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).alias("key"), v.alias("vector")).where(F.col("key").isNotNull() & F.coalesce(fine, F.lit(False)))


def build_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", lists: int | None = None, sample: int = 20_000) -> VectorIndex:
    """An index of all usable vectors, of one width; `lists` is about the root of their number, MOST_LISTS at most. Keys of
    equal vectors all stay. Rows without a key or with an unusable vector aren't indexed."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)
    n = rows.count()
    if not n:
        raise ValueError("there are no vectors to index")
    few = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toArrow().column("vector")  # at most `sample` rows
    dim = len(few[0])
    found = unit_rows(few, dim)
    count = min(MOST_LISTS, len(found), lists or ceil(sqrt(n)))
    index = VectorIndex(run_dir(spark, "vectors"), spherical_centroids(found, count))
    shared = spark.sparkContext.broadcast(index.centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit_rows(batch.column("vector"), dim) @ shared.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["key", "vector", "list"])

    kind = dict(rows.dtypes)["key"]
    placed = rows.mapInArrow(assign, f"key {kind}, vector array<double>, list int")
    # rows of a list lie together; a large list is as many files as it needs
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("list").option("maxRecordsPerFile", 1_000_000).parquet(f"{index.path}/lists")
    return index


def search_one(spark: SparkSession, index: VectorIndex, query: list[float], k: int, probes: int | None = 8) -> DataFrame:
    """(key, score) of the k most similar rows in the `probes` nearest lists: only their folders are read."""
    v = np.array(query, float)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        raise ValueError("the query vector is empty, zero or not finite")
    rows = index.rows(spark)
    if probes is not None:
        rows = rows.where(F.col("list").isin(*index.nearest_lists(v[None, :], probes)[0].tolist()))
    score = cosine(F.col("vector"), F.array(*map(F.lit, v.tolist())))
    return rows.select("key", score.alias("score")).orderBy(F.col("score").desc(), "key").limit(k)


def best_of(asked: np.ndarray, rows: np.ndarray, probed: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows that each query probes, ties by place. A product of matrices finds candidates; their scores are
    then worked out row by row, so that equal vectors have equal scores."""
    long = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (asked, rows)]
    near = np.where(probed, (asked / long[0][:, None]) @ (rows / long[1][:, None]).T, -np.inf)
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(near), -2.0)
    q, r = np.nonzero(probed & (near >= least[:, None] - 1e-9))
    score = np.einsum("ij,ij->i", asked[q], rows[r]) / (long[0][q] * long[1][r])
    order = np.lexsort((place[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], score[keep]


def search_each(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query, key, score, rank) of the k most similar rows for each query (a table of any size), ties by key. Queries meet the rows of the
    lists they probe in blocks: neighbouring lists share one, a large list is several, and so are many queries. Each block keeps k a query.
    A query with an unusable vector has no rows."""
    spark = queries.sparkSession
    dim, shared = index.centroids.shape[1], spark.sparkContext.broadcast(index)
    most = len(index.centroids) if probes is None else probes
    rows = index.rows(spark)
    asked = usable(queries, key, column)
    together = max(1, len(index.centroids) * BLOCK // max(1, rows.count()))
    decks = max(1, ceil(asked.count() / BLOCK))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.sort(shared.value.nearest_lists(unit_rows(batch.column("vector"), dim), most), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["query", "probe", "lists"])

    types = dict(asked.dtypes)["key"], dict(rows.dtypes)["key"]
    bin_of = lambda c: F.floor(c / together).cast("int")
    # a bin is a number of a list at most: few rows
    parts = rows.groupBy(bin_of(F.col("list")).alias("bin")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    placed = rows.withColumn("bin", bin_of(F.col("list"))).join(F.broadcast(parts), "bin").withColumn("part", F.pmod(F.xxhash64("key"), "parts")).drop("parts")
    placed = placed.withColumn("deck", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(decks - 1).cast("long"))))
    asked = asked.mapInArrow(probe, f"query {types[0]}, probe array<double>, lists array<int>").withColumn("deck", F.pmod(F.xxhash64("query"), F.lit(decks)).cast("long"))
    asked = asked.withColumn("bin", F.explode(F.array_distinct(F.transform("lists", bin_of)))).withColumn("lists", F.filter("lists", lambda x: bin_of(x) == F.col("bin")))
    asked = asked.join(F.broadcast(parts), "bin").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = []
        if len(ours) and len(theirs):
            vectors = np.array(theirs.column("vector").to_pylist(), float).reshape(-1, dim)
            lists, keys = theirs.column("list").to_numpy(), theirs.column("key").to_pylist()
            place = np.empty(len(keys), np.int64)
            place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
            for start in range(0, len(ours), DECK):
                few = ours.slice(start, DECK)
                probed = np.zeros((len(few), len(index_lists)), bool)
                for i, some in enumerate(few.column("lists").to_pylist()):
                    probed[i, some] = True
                q, r, score = best_of(np.array(few.column("probe").to_pylist(), float).reshape(-1, dim), vectors, probed[:, lists], place, k)
                found.append(pa.Table.from_arrays([few.column("query").take(pa.array(q)), theirs.column("key").take(pa.array(r)), pa.array(score)], names=["query", "key", "score"]))
        return pa.concat_tables(found) if found else pa.Table.from_arrays([ours.column("query").slice(0, 0), theirs.column("key").slice(0, 0), pa.array([], pa.float64())], names=["query", "key", "score"])

    index_lists = range(len(index.centroids))
    by = ["bin", "part", "deck"]
    best = asked.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(meet, f"query {types[0]}, key {types[1]}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
