"""The calls' further filters, and the cover density against every stretch of words."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import text
from ledgerline.operators.screen import BadRequest
from ledgerline.plans import api, catalog

SF = "/root/testdata/sf0.001"


def density(parts, wanted):
    """Score of (text, weight) parts by looking at every stretch of words."""
    words = [(w, 1 / weight) for body, weight in parts for w in re.findall(r"[a-z]+", (body or "").lower())]
    hits = [(i, w, inverse) for i, (w, inverse) in enumerate(words) if w in wanted]
    full = lambda i, j: {w for p, w, _ in hits if i <= p <= j} == set(wanted)
    total, n = 0.0, len(words)
    for i in range(n):
        for j in range(i, n):
            if full(i, j) and not full(i + 1, j) and not full(i, j - 1):
                inside = [inverse for p, _, inverse in hits if i <= p <= j]
                total += len(inside) / sum(inside) / (1 + j - i + 1 - len(inside))
    return round(total, 4)


def test_cover_density_against_all_stretches(spark):
    rng = random.Random(3)
    words = ["bank", "loan", "the", "rent", "sum", "part"]
    make = lambda: " ".join(rng.choices(words, k=rng.randint(0, 14)))
    rows = [(i, rng.choice([None, "", make()]), make()) for i in range(120)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "x", "")], "doc_id int, title string, content string")
    for query in ("bank", "the bank loans", "rent sum part"):
        wanted = [w for w in ("bank", "loan", "rent", "sum", "part") if re.search(w, query)]
        want = {k: s for k, a, b in rows if (s := density([(a, 1.0), (b, 0.4)], wanted))}
        got = {r.doc_id: r.score for r in text.cover_density(docs, query, "doc_id", {"title": 1.0, "content": 0.4}).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-4 for k in got)
    assert text.cover_density(docs, "the of", "doc_id", {"title": 1.0}).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_filters_are_checked(spark):
    b = catalog.book(spark, SF)
    marks = spark.createDataFrame([(1, 5.0, 300, 10, "TRACE"), (2, None, 300, 10, "TRACE"), (3, 5.0, 0, None, "estimate")], "instrument_id long, last_price double, ytm_bps int, spread_bps int, source string")
    with pytest.raises(BadRequest):
        api.search_bonds(b, min_ytm=3)
    with pytest.raises(BadRequest):
        api.search_companies(b, min_leverage=3)
    with pytest.raises(BadRequest):
        api.search_companies(b, metrics=marks.withColumnRenamed("instrument_id", "company_id"), has_holdco_debt=True)
    with pytest.raises(BadRequest):
        api.search_documents(b, marks, " a ")
    every = api.search_bonds(b, marks=marks, active=None)
    assert every.total() == api.search_bonds(b, active=None).total()
    assert {r.id for r in api.search_bonds(b, marks=marks, active=None, has_pricing=True).df.collect()} <= {1}
    assert not {r.id for r in api.search_bonds(b, marks=marks, active=None, has_pricing=False).df.collect()} & {1, 3}
    shown = {r.id: r.pricing for r in api.with_pricing(every.where(F.col("id") <= 3).df).collect()}
    assert all(v is None or k == 1 for k, v in shown.items())
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "company_id long, has_holdco_debt boolean")
    assert [r.id for r in api.search_companies(b, metrics=flags, has_holdco_debt=False).df.collect()] == [2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_document_search_orders_and_snippets(spark):
    b = catalog.book(spark, SF)
    rows = [(i, i % 3 + 1, "8-K", "indenture", "Loan", f"a revolving loan {'x ' * i}", None) for i in range(5)]
    sections = spark.createDataFrame(rows, "doc_id int, company_id long, doc_type string, section_type string, title string, content string, filed date")
    got = api.search_documents(b, sections, "revolving loan", section_type="indenture", sort="nonsense").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4] and all("<b>revolving</b> <b>loan</b>" in r.snippet for r in got)
    assert api.search_documents(b, sections, "revolving loan", doc_type="10-K").count() == 0
