"""Exports, costs, numbering, maturities, searches by instrument, and results checked against themselves, at their edges."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import costs
from ledgerline.operators import aggregates, consistency
from ledgerline.operators.screen import BadRequest
from ledgerline.plans import api
from ledgerline.sources import export, results


def test_numbered_runs_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 3 or None) for i in range(1000)], "k int, g int").repartition(5)
    got = aggregates.numbered(rows, F.col("g").asc_nulls_last(), F.col("k").desc(), name="place")
    want = sorted(((r.g is None, r.g or 0, -r.k), r.k) for r in rows.collect())
    assert {(r.k, r.place) for r in got.collect()} == {(k, n + 1) for n, (_, k) in enumerate(want)}
    assert got.columns == ["k", "g", "place"]
    assert aggregates.numbered(rows.limit(0), "k").count() == 0


def test_weighted_maturity(spark):
    day = datetime.date
    rows = [(1, 100, day(2026, 1, 1)), (1, 300, day(2020, 1, 1)), (1, None, day(2030, 1, 1)), (2, 50, None), (3, None, day(2030, 1, 1)), (4, 5, day(9999, 1, 1))]
    df = spark.createDataFrame(rows, "c int, amount long, due date")
    got = {r.c: r.m for r in df.groupBy("c").agg(aggregates.weighted_maturity(F.col("amount"), F.col("due"), F.lit(day(2025, 1, 1))).alias("m")).collect()}
    assert got == {1: pytest.approx(0.25), 2: 0.0, 3: None, 4: 999.9}


def test_costs(spark):
    paths = ["/v1/companies/AAPL/changes", "/v1/companies", "/v1/entities/traverse", "/v1/batch", "/v1/new"]
    df = spark.createDataFrame([(p, t) for p in paths for t in ("pay_as_you_go", "pro", "business")], "path string, tier string")
    got = {(r.path, r.tier): r.c for r in df.withColumn("c", costs.call_cost(F.col("path"), F.col("tier"))).collect()}
    assert [got[p, "pay_as_you_go"] for p in paths] == [10, 5, 15, 15, 5]
    assert {got[p, t] for p in paths for t in ("pro", "business")} == {0}
    month = spark.createDataFrame([("pay_as_you_go", 7, "balanced"), ("pay_as_you_go", 7, "complex"), ("pro", 7, "simple"), ("business", 0, None)], "t string, n int, m string")
    assert [r.c for r in month.select(costs.monthly_cost(F.col("t"), F.col("n"), F.col("m")).alias("c")).collect()] == [70, 70, 19900, 49900]


def test_export_needs_a_known_kind(spark):
    companies = spark.createDataFrame([(1, "A", None, "X")], "id int, ticker string, sector string, country string")
    with pytest.raises(BadRequest):
        export.export_frame({"companies": companies}, "users")


def book(spark):
    companies = spark.createDataFrame([(1, "AA", "x"), (2, "BB", "y")], "id int, ticker string, sector string")
    debt = spark.createDataFrame([(10, 1, "C10", "low", True), (11, 1, None, "high", True), (20, 2, "C20", "low", True), (21, 2, "C21", "low", False)], "id int, company_id int, cusip string, seniority string, is_active boolean").withColumns({"name": F.lit("n"), "maturity_date": F.lit(None).cast("date")})
    collateral = spark.createDataFrame([(10, 1, "land", "first", 5), (11, 1, "land", "second", None), (20, 1, "cash", "first", 9), (None, 2, "cash", "first", 1)], "instrument_id int, line int, collateral_type string, priority string, value long")
    covenants = spark.createDataFrame([(1, 1, 10, "Change of Control", "maximum", 90), (2, 2, None, "leverage", "minimum", None), (3, 2, 20, "LEVERAGE cap", "maximum", 50)], "id int, company_id int, instrument_id int, covenant_name string, threshold_type string, confidence_pct int").withColumns({"covenant_type": F.lit("f"), "test_metric": F.lit("m"), "threshold": F.lit(1)})
    empty = spark.range(0)
    return api.Book(companies, empty, debt, empty, collateral, empty, empty, covenants)


def test_searches_by_instrument(spark):
    b = book(spark)
    lines = lambda **k: {(r.instrument_id, r.line) for r in api.search_collateral(b, **k).df.collect()}
    assert lines() == {(10, 1), (11, 1), (20, 1), (None, 2)}
    assert lines(ticker="AA") == {(10, 1), (11, 1)}
    assert lines(instruments="10, 20") == lines(cusip="c10,C20") == lines(seniority="low") == {(10, 1), (20, 1)}
    assert lines(ticker="AA,BB", priority="first", min_value=6) == {(20, 1)}
    assert lines(cusip="NONE") == set()
    ids = lambda **k: {r.id for r in api.search_covenants(b, **k).df.collect()}
    assert ids() == {1, 2, 3}
    assert ids(ticker="BB") == {2, 3}
    assert ids(name="leverage", threshold_type="maximum") == ids(instruments="20") == {3}
    assert ids(min_confidence=0.5) == {1, 3}
    marks = spark.createDataFrame([(10, 99.0, 500, 10, "TRACE"), (11, 98.0, 700, None, "estimate"), (20, None, 600, 5, "TRACE"), (21, 97.0, 600, 5, "TRACE")], "instrument_id int, last_price double, ytm_bps int, spread_bps int, source string")
    priced = lambda **k: {r.instrument_id for r in api.search_pricing(b, marks, **k).df.collect()}
    assert priced() == {10, 11}
    assert priced(min_ytm=6) == {11}
    assert priced(traded_only=True) == priced(max_spread=10) == priced(cusip="C10") == {10}


def test_consistency(spark):
    holdco = {"name": "Top", "entity_type": "holdco"}
    cases = [
        {"entities": [holdco, {"name": "Kid Corp.", "owners": [{"parent_name": "TOP"}, {"parent_name": None}, 3]}], "debt_instruments": [{"name": "N", "issuer_name": "kid corporation", "guarantor_names": ["Top", None, ""], "outstanding": 0, "principal": 10**15}]},
        {"entities": [], "debt_instruments": [{"name": "N", "principal": -1}]}, {"entities": [holdco], "debt": [{"name": "N", "issuer": "Gone", "guarantors": ["Lost", "Lost"]}, {"name": "M", "amount": 10**15 + 1}]}, "text", None,
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, None)], "id int, text string")
    read = results.parsed_results(df, "id", "text")
    assert {(r.id, r.issue, r.named) for r in consistency.issues(read, "id").collect()} == {(1, "negative_amount", "-1.00"), (1, "no_holdco", None), (2, "issuer", "Gone"), (2, "guarantor", "Lost"), (2, "large_amount", "1000000000000001.00")}
    assert {r.id: (r.status, r.n) for r in consistency.consistency(read, "id").collect()} == {0: ("pass", 0), 1: ("fail", 2), 2: ("fail", 3), 3: ("skip", 0), 4: ("skip", 0), 9: ("skip", 0)}
    both = [("pass", "pass", None, (100.0, "pass", 0)), ("warn", "warn", "pass", (80.0, "needs_review", 2)), ("warn", None, "skip", (70.0, "needs_review", 1)), ("fail", "pass", "pass", (pytest.approx(200 / 3), "fail", 1)), (None, None, None, (0.0, "needs_review", 0)), ("warn", "pass", "pass", (90.0, "pass", 1))]
    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(both)], "i int, a string, b string, c string")
    got = {r.i: tuple(r.v) for r in rows.select("i", consistency.verdict([F.col(c) for c in "abc"]).alias("v")).collect()}
    assert got == {i: x[3] for i, x in enumerate(both)}
