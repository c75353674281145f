import os
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.screen import BadRequest, NotFound
from ledgerline.plans import api, catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def book(spark):
    return catalog.book(spark, SF)


def test_arguments_are_checked(book):
    with pytest.raises(BadRequest):
        api.resolve_bond(book)
    with pytest.raises(BadRequest):
        api.price_history(book, 1, date(1990, 1, 1), date(1998, 1, 1))
    with pytest.raises(BadRequest):
        api.compare_covenants(book, [1])
    with pytest.raises(BadRequest):
        api.search_financials(book, period="last year")
    with pytest.raises(NotFound):
        api.traverse(book, "nobody")


def test_newest_annual_filing_stands_alone(spark, book):
    rows = [(1, 2023 + (q == 0), q or 4, "10-Q" if q else "10-K", date(2024, 12 - q, 1), 10 + q) for q in range(4)]
    rows += [(2, 2024, 4 - q, "10-K" if q == 1 else "10-Q", date(2024, 12 - q, 1), 10 + q) for q in range(4)]
    rows += [(3, 2024, 1, None, date(2024, 1, 1), 5)]
    df = spark.createDataFrame(rows, "company_id long, fiscal_year int, fiscal_quarter int, filing_type string, period_end date, revenue long")
    for c in ("ebitda", "interest_expense", "cash", "total_debt"):
        df = df.withColumn(c, F.col("revenue"))
    got = {r.company_id: (r.revenue, r.quarters) for r in api.search_financials(replace(book, financials=df), period="LTM").df.collect()}
    assert got == {1: (10, 1), 2: (46, 4), 3: (5, 1)}


def test_false_is_a_filter(book):
    every = api.search_bonds(book).total()
    priced = api.search_bonds(book, has_pricing=True).total()
    assert api.search_bonds(book, has_pricing=False).total() == every - priced


def test_batch_goes_on_after_a_failure(book):
    known = {"bonds": lambda **k: api.search_bonds(book, **k).page(2), "history": lambda **k: api.price_history(book, 1, None, date(1998, 1, 1))}
    got = api.batch([{"primitive": "bonds", "params": {"rate_type": "fixed"}}, {"primitive": "nothing"}, {"primitive": "bonds", "params": {"bad": 1}}, {"primitive": "history"}], known)
    assert [r["status"] for r in got["results"]] == ["success", "error", "error", "success"] and got["meta"]["failed"] == 2
    with pytest.raises(BadRequest):
        api.batch([], known)
