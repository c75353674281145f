"""Whether a result of an extraction agrees with itself, and what several checks say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_name, once
from ..sources import results
from ..sources.results import ENTITY, INSTRUMENT

#: An amount above this many cents is no amount; scores of a check by its status; the least score that passes.
MOST = 1_000_000_000_000_000
SCORES = {"pass": 100, "warn": 70, "fail": 0}
PASSES = 80
#: The fields that are checked, no others: each is a way through the text of an item.
OWNERS = {**{n: ENTITY[n] for n in ("name", "entity_type", "parent")}, "owners": (("owners",), "array<variant>")}
OWING = {**{n: INSTRUMENT[n] for n in ("name", "issuer", "outstanding", "guarantors")}, "principal": (("principal", "principal_amount"), "decimal(20,2)")}


ISSUE = "array<struct<issue: string, subject: string, named: string>>"


def checked(read: DataFrame, key: str) -> DataFrame:
    """(key, fault, issues) of each row. A result is read once and looked up in itself: nothing of it leaves its row."""
    issue = lambda name, subject, named: F.struct(F.lit(name).alias("issue"), subject.alias("subject"), named.alias("named"))
    rows = read.select(key, "fault", F.array(F.struct(results.items("entities", OWNERS).alias("people"), results.items("instruments", OWING).alias("debt"))).alias("x"))
    rows = rows.select(key, "fault", F.explode("x").alias("x")).select(key, "fault", "x.*")

    owners = lambda p: F.transform(F.coalesce(p["owners"], F.array().cast("array<variant>")), lambda v: F.try_variant_get(v, "$.parent_name", "string"))
    parents = F.flatten(F.transform("people", lambda p: F.transform(F.concat(owners(p), F.array(p["parent"])), lambda n: issue("parent", p["name"], n))))
    issuers = F.transform("debt", lambda d: issue("issuer", d["name"], d["issuer"]))
    givers = F.flatten(F.transform("debt", lambda d: F.transform(F.coalesce(d["guarantors"], F.array().cast("array<string>")), lambda n: issue("guarantor", d["name"], n))))
    refs = F.filter(F.concat(parents, issuers, givers), lambda r: r["named"] != "")
    names = F.transform("people", lambda p: p["name"])
    # what is known by its name as it stands needs no normal form
    strange = once(names, lambda known: F.array_distinct(F.filter(refs, lambda r: ~F.array_contains(known, r["named"]))))
    unlike = lambda asked: once(F.transform(names, normal_name), lambda known: F.filter(asked, lambda r: ~F.array_contains(known, normal_name(r["named"]))))
    missing = once(strange, lambda asked: F.when(F.size(asked) == 0, asked).otherwise(unlike(asked)))

    amount = lambda d: F.coalesce(F.nullif(d["outstanding"], F.lit(0)), d["principal"], F.lit(0))
    judged = lambda d: once(amount(d), lambda x: F.struct(F.when(x < 0, "negative_amount").when(x > MOST, "large_amount").alias("issue"), d["name"].alias("subject"), x.cast("string").alias("named")))
    odd = F.transform("debt", judged)
    amounts = F.filter(odd, lambda r: r["issue"].isNotNull())
    topped = F.exists("people", lambda p: F.coalesce(p["entity_type"] == "holdco", F.lit(False)))
    text = F.lit(None).cast("string")
    no_top = F.when(F.col("fault").isNull() & ~topped, F.array(issue("no_holdco", text, text))).otherwise(F.array().cast(ISSUE))
    return rows.select(key, "fault", F.concat(missing.cast(ISSUE), amounts.cast(ISSUE), no_top.cast(ISSUE)).alias("issues"))


def issues(read: DataFrame, key: str) -> DataFrame:
    """(key, issue, subject, named): parents, issuers and guarantors that are no entity of the result, by name or by its normal form;
    negative and impossible amounts; and no_holdco where no entity is one. `read` as from results.parsed_results, each row a result; results
    with a fault have no issues, for nothing of them was read."""
    return checked(read, key).select(key, F.explode("issues").alias("x")).select(key, "x.*")


def consistency(read: DataFrame, key: str) -> DataFrame:
    """(key, status, n): fail where there are issues, pass where there are none, skip for results with a fault."""
    rows = checked(read, key).select(key, "fault", F.size("issues").cast("long").alias("n"))
    return rows.select(key, F.when(F.col("fault").isNotNull(), "skip").when(F.col("n") > 0, "fail").otherwise("pass").alias("status"), "n")


def verdict(statuses: list[Column]) -> Column:
    """{score, status, review} of checks that pass, warn, fail or skip (null: skip): the mean score of those that count; fail if one
    fails, needs_review with two warnings or less than PASSES, else pass. `review` counts those that a person should see."""
    each = F.filter(F.array(*statuses), lambda s: s.isin(*SCORES))
    points = F.transform(each, lambda s: F.when(s == "pass", float(SCORES["pass"])).when(s == "warn", float(SCORES["warn"])).otherwise(float(SCORES["fail"])))
    score = F.when(F.size(each) > 0, F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.size(each)).otherwise(0.0)
    count = lambda name: F.size(F.filter(each, lambda s: s == name))
    status = F.when(count("fail") > 0, "fail").when((count("warn") > 1) | (score < PASSES), "needs_review").otherwise("pass")
    return F.struct(score.alias("score"), status.alias("status"), (count("fail") + count("warn")).alias("review"))
