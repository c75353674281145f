"""Matching of filing documents to instruments, and of names to names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import bare_name

HIGH, LOW, KEEP = 0.70, 0.50, 0.40


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; a small helper for pairs that a join has already narrowed down."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    tidy = lambda s: " ".join(sorted(s.lower().split()))
    return pd.Series([SequenceMatcher(None, tidy(x), tidy(y)).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def name_grams(names: DataFrame, name: str) -> DataFrame:
    """(columns of names, size, gram, nth): the pairs of neighbouring letters of each name between marks; a pair
    that occurs again has the next `nth`."""
    marked = F.concat(F.lit("^"), F.col(name), F.lit("$"))
    pairs = names.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(marked, i, F.lit(2)))))
    counted = pairs.groupBy(*names.columns, "gram").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*names.columns, (F.length(name) + 1).alias("size"), "gram", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))


def similar_names(left: DataFrame, right: DataFrame, within: list[str], least: float) -> DataFrame:
    """(within, __bare, __other, score) of all pairs of distinct names with a ratio of at least `least`, which is above 2/3.

    Names of a and b letters with a ratio r share r * (a + b) / 2 letters in order, and every other letter breaks
    at most one pair of neighbours, so they share at least 1 + (1.5 * r - 1) * (a + b) such pairs. Hence they
    meet on one of the rarest pairs of either, as many as that bound leaves; lengths and the edit distance,
    which is at most (1 - r) * (a + b), are looked at before the ratio itself."""
    if least <= 2 / 3:
        raise ValueError("names meet by their letters only if the ratio is above 2/3")
    sides = [name_grams(left, "__bare"), name_grams(right, "__bare")]
    common = sides[0].select("gram", "nth").unionByName(sides[1].select("gram", "nth")).groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("seen"))
    share = (1.5 * least - 1) * 2 / (2 - least)

    def rarest(grams: DataFrame) -> DataFrame:
        w = Window.partitionBy(*within, "__bare").orderBy("seen", "gram", "nth")
        keep = F.col("size") - F.ceil(1 + share * (F.col("size") - 1) - 1e-9) + 1
        return grams.join(common, ["gram", "nth"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select(*within, "__bare", "gram", "nth")

    pairs = rarest(sides[0]).join(rarest(sides[1]).withColumnRenamed("__bare", "__other"), [*within, "gram", "nth"])
    short, long = F.least(F.length("__bare"), F.length("__other")), F.greatest(F.length("__bare"), F.length("__other"))
    near = pairs.where(2 * short >= (least - 1e-9) * (short + long)).select(*within, "__bare", "__other").distinct()
    near = near.where(F.levenshtein("__bare", "__other") <= (1 - least) * (F.length("__bare") + F.length("__other")) + 1e-9)
    return near.withColumn("score", sequence_ratio("__bare", "__other")).where(F.col("score") >= least)


def fuzzy_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, key: str, least: float = 0.85, within: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with its best right name: the ratio of the bare names decides, ties go to the smaller right
    name. `within` names columns of both sides, such as the company, that must be equal. Every pair that reaches
    `least` is found. Names are compared once each, and one whose equal is known needs no search. Null names match nothing."""
    by = list(within)
    a = left.withColumn("__bare", bare_name(F.col(left_name))).where(F.col("__bare").isNotNull())
    first = Window.partitionBy(*by, "__other").orderBy(right_name)
    b = right.withColumn("__other", bare_name(F.col(right_name))).where(F.col("__other").isNotNull()).withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    ours, theirs = a.select(*by, "__bare").distinct(), b.select(*by, F.col("__other").alias("__bare")).distinct()
    equal = ours.join(theirs, [*by, "__bare"], "left_semi").select(*by, "__bare", F.col("__bare").alias("__other"), F.lit(1.0).alias("score"))
    near = similar_names(ours.join(theirs, [*by, "__bare"], "left_anti"), theirs, by, least)
    links = equal.unionByName(near)
    best = Window.partitionBy(*by, "__bare").orderBy(F.col("score").desc())
    links = links.withColumn("__rank", F.rank().over(best)).where("__rank = 1").drop("__rank")
    rows = a.join(links, [*by, "__bare"]).join(b, [*by, "__other"])
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), right_name)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth", "__bare", "__other")


def document_score(identifier: Column, coupon: Column, year: Column, issuer: Column, days: Column, amount_off: Column) -> Column:
    """The strongest of several signals, not their sum. What each signal is worth."""
    return F.greatest(
        F.when(identifier, 0.95).otherwise(0.0),
        F.when(coupon & year & issuer, 0.90).when(coupon & year, 0.75).otherwise(0.0),
        F.when(days == 0, 0.85).when(days <= 7, 0.75).otherwise(0.0),
        F.when(issuer & year, 0.65).otherwise(0.0),
        F.when(coupon & year, 0.55).otherwise(0.0),
        F.when(amount_off <= 0.05, 0.45).otherwise(0.0),
    )


def matched(pairs: DataFrame, instrument: str, score: str) -> DataFrame:
    """Best document of each instrument above KEEP, with its band."""
    w = Window.partitionBy(instrument).orderBy(F.col(score).desc(), "doc_id")
    best = pairs.where(F.col(score) >= KEEP).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return best.withColumn("band", F.when(F.col(score) >= HIGH, "high").when(F.col(score) >= LOW, "medium").otherwise("low"))


def relationship(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike("supplement"), "supplements").when(t.rlike("amend"), "amends").when(t.rlike("guarant|security agreement|pledge"), "related").otherwise("governs")
