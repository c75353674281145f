"""Joins beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).dropna(), list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """What has no partner; null keys on the other side never match, unlike NOT IN."""
    return df.join(other.select(*on).dropna(), list(on), "left_anti")


def semi_any(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which any of several columns has a partner: a union of keys, not an OR join, which would
    have no equality to shuffle by."""
    keyed = df.select("*", F.explode(F.array_distinct(F.array(*columns))).alias("ledgerline_key")).where("ledgerline_key is not null")
    hit = keyed.join(other.select(F.col(key).alias("ledgerline_key")).distinct(), "ledgerline_key", "left_semi")
    return hit.drop("ledgerline_key").distinct()


def latest_ties(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """All rows that share the largest `order` of their group."""
    last = df.groupBy(*by).agg(F.max(order).alias(order))
    return df.join(last, [*by, order], "left_semi")


def latest_one(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each group, combined before the shuffle: no window over the group."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("ledgerline_row"))
    return best.select(*by, "ledgerline_row.*")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time. Both sides go through
    one shuffle and one running window; the right rows come first among equals."""
    tag = "ledgerline_side"
    own = [c for c in left.columns]
    up = left.select(F.struct(*own).alias("row"), *by, F.col(left_time).alias("time"), F.lit(1).alias(tag), F.lit(None).cast(f"struct<{','.join(f'{v}:{t}' for v, t in right.dtypes if v in values)}>").alias("seen"))
    down = right.select(F.lit(None).cast(up.schema["row"].dataType).alias("row"), *by, F.col(right_time).alias("time"), F.lit(0).alias(tag), F.struct(*[c for c, _ in right.dtypes if c in values]).alias("seen"))
    w = Window.partitionBy(*by).orderBy("time", tag).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = up.unionByName(down).withColumn("seen", F.last("seen", ignorenulls=True).over(w)).where(f"{tag} = 1")
    return joined.select("row.*", *[F.col(f"seen.{v}").alias(v) for v in values])


def band(left: DataFrame, right: DataFrame, by: Sequence[str], column: str, width: int, suffix: str = "_other") -> DataFrame:
    """Pairs of equal keys with |difference| <= width, by bucket: the right side goes to its own bucket
    and both neighbours, so the join stays an equality join."""
    bucket = F.floor(F.col(column) / width).cast("long")
    a = left.withColumn("ledgerline_bucket", bucket)
    b = right.select(*[F.col(c).alias(c if c in by else c + suffix) for c in right.columns], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("ledgerline_bucket"))
    pairs = a.join(b, [*by, "ledgerline_bucket"]).where(F.abs(F.col(column) - F.col(column + suffix)) <= width)
    return pairs.drop("ledgerline_bucket")


def best_match(pairs: DataFrame, key: str, score: Column, least: float, ties: Sequence[Column]) -> DataFrame:
    """The best pair of each key whose score reaches `least`; `ties` decide among equals."""
    rows = pairs.withColumn("score", score).where(F.col("score") >= least)
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("ledgerline_rank", F.row_number().over(w)).where("ledgerline_rank = 1").drop("ledgerline_rank")


def changes(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """(key, status): added, removed or kept, by one full outer join of the keys."""
    a = before.select(*on).distinct().withColumn("was", F.lit(True))
    b = after.select(*on).distinct().withColumn("now", F.lit(True))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("kept")
    return a.join(b, list(on), "full_outer").select(*on, status.alias("status"))
