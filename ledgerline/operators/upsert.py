"""Keyed writes as DataFrames: each gives the whole new table, which the caller writes to a new place or over its partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key; of new rows with one key the last by `order` counts. Keys with a null replace nothing."""
    key = [F.col(c) for c in on]
    tagged = old.withColumn("ledgerline_new", F.lit(0)).unionByName(new.withColumn("ledgerline_new", F.lit(1)))
    w = Window.partitionBy(*on).orderBy(F.col("ledgerline_new").desc(), *[F.col(c).desc() for c in order])
    # old and new rows are sorted together once: a task holds neither of them in a table by key
    ranked = tagged.withColumns({"ledgerline_n": F.row_number().over(w), "ledgerline_met": F.first("ledgerline_new").over(w)})
    kept = F.when(F.col("ledgerline_new") == 1, F.col("ledgerline_n") == 1).otherwise((F.col("ledgerline_met") == 0) | reduce(or_, [c.isNull() for c in key]))
    return ranked.where(kept).select(*on, *[c for c in old.columns if c not in on])


def filled(old: DataFrame, new: DataFrame, on: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Keep what is known: new values where they aren't null, flags only from false to true, missing rows added."""
    rest = [c for c in old.columns if c not in on]
    both = old.alias("o").join(new.alias("n"), list(on), "full_outer")
    value = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(False)) | F.coalesce(F.col(f"n.{c}"), F.lit(False)) if c in flags else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return both.select(*on, *[value(c).alias(c) for c in rest])


def replaced(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Delete all old rows of the new rows' keys, then add the new rows."""
    return old.join(new.select(*on).distinct(), list(on), "left_anti").unionByName(new)


def appended_once(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(on)).join(old.select(*on), list(on), "left_anti"))


def flagged(df: DataFrame, condition: Column, flag: str, value: bool, json: str | None = None, facts: Mapping[str, str] | None = None) -> DataFrame:
    """Set a flag where the condition holds, and merge facts into a JSON column."""
    hit = F.coalesce(condition, F.lit(False))
    out = df.withColumn(flag, F.when(hit, F.lit(value)).otherwise(F.col(flag)))
    if json and facts:
        added = F.create_map(*[F.lit(x) for kv in facts.items() for x in kv])
        known = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(known, lambda k, _: ~k.isin(list(facts)))
        out = out.withColumn(json, F.when(hit, F.to_json(F.map_concat(kept, added))).otherwise(F.col(json)))
    return out


def removed(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): a delete with its returned rows."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.where(hit)
