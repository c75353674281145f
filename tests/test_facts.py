"""Documents and instruments by facts: each signal, nulls, links that exist, and no pair without a fact in common."""

import datetime

from pyspark.sql import functions as F

from ledgerline.operators import facts, linking

DAY = datetime.date
PAPERS = "company_id int, doc_id int, kind string, title string, content string, filed date"
DEBT = "company_id int, id int, instrument_type string, rate_bps int, issue_date date, maturity_date date, is_active boolean, outstanding long, principal long, name string, cusip string, isin string, issuer string"


def book(spark):
    far, k = DAY(2040, 1, 1), "indenture"
    papers = [
        (1, 10, k, "Deed", "the notes, CUSIP 037833100, were sold", far), (1, 11, k, "Deed", "ISIN US0378331005.", far), (1, 12, k, "4.125% Senior Notes due 2031", "", far),
        (1, 13, k, "Acme Widgets Inc Indenture", "final in 2033", far), (1, 14, k, "First Supplemental Deed", "Issuer: Acme Widgets, dated as of March 5, 2021", far), (1, 15, k, "Deed", "paid at 5.254 % until 2036", far),
        (1, 16, k, "Deed", "maturing on June 30, 2037", far), (1, 17, k, None, None, DAY(2020, 5, 8)), (1, 18, "credit_agreement", "Loan", "CUSIP 037833100", far), (1, 19, k, "Deed", "due Foo 99, 2030 dated June 31, 2021", far),
        (1, 20, k, "Deed", "CUSIP 037833100", far), (2, 21, k, "Deed", "CUSIP 037833100", far), (1, 22, "note", "Deed", "CUSIP 037833100", far), (None, 23, k, "Deed", "CUSIP 037833100", far),
    ]
    none = (None, None, None)
    debt = [
        (1, 100, "senior_notes", None, None, None, True, *none, "037833100", None, None), (1, 101, "Senior_Notes", None, None, None, True, *none, None, "us0378331005", None),
        (1, 102, "notes", 412, None, DAY(2031, 1, 1), True, None, None, "4.125% Senior Notes due 2031", None, None, None), (1, 103, "bonds", 0, DAY(2021, 3, 8), DAY(2033, 2, 2), True, *none, None, None, "ACME WIDGETS, LLC"),
        (1, 104, "bonds", None, DAY(2021, 3, 5), None, True, *none, None, None, "Acme Widgets Overseas"), (1, 105, "debentures", 525, None, DAY(2036, 9, 9), True, *none, None, None, None), (1, 106, "debentures", 526, None, DAY(2036, 9, 9), True, *none, None, None, None),
        (1, 107, "notes", None, None, DAY(2037, 6, 30), True, *none, None, None, None), (1, 108, "notes", None, DAY(2020, 5, 1), None, True, *none, None, None, None), (1, 109, "notes", None, DAY(2020, 5, 8), None, True, *none, None, None, None),
        (1, 110, "notes", None, DAY(2020, 4, 30), None, True, *none, None, None, None), (1, 111, "term_loan_b", None, None, None, True, *none, "037833100", None, None), (1, 112, "notes", None, None, None, False, *none, "037833100", None, None),
        (1, 113, None, None, None, None, True, *none, "037833100", None, None), (None, 114, "notes", None, None, None, True, *none, "037833100", None, None), (1, 115, "convertible_notes_term_loan", None, None, None, True, *none, "0378 33100", None, None),
    ]
    return spark.createDataFrame(papers, PAPERS), spark.createDataFrame(debt, DEBT)


def test_reverse_links(spark):
    papers, debt = book(spark)
    for heads in (facts.Heads(), facts.WHOLE):
        got = {(r.doc_id, r.instrument_id): (r.score, r.method) for r in facts.reverse_links(papers, debt, papers.where("doc_id = 20"), heads=heads).collect()}
        assert got == {
            (10, 100): (0.95, "identifier"), (10, 115): (0.95, "identifier"), (11, 101): (0.95, "identifier"), (12, 102): (0.85, "note_description"), (13, 103): (0.75, "issuer_maturity"),
            (14, 103): (0.70, "issuer_issue_date"), (14, 104): (0.80, "issuer_issue_date"), (15, 105): (0.50, "reverse_match"), (15, 106): (0.50, "reverse_match"), (16, 107): (0.65, "reverse_match"),
            (17, 108): (0.55, "reverse_match"), (17, 109): (0.70, "reverse_match"), (18, 111): (0.95, "identifier"), (18, 115): (0.95, "identifier"),
        }
    strict = facts.reverse_links(papers, debt, papers.limit(0), least=0.9)
    assert {(r.doc_id, r.instrument_id) for r in strict.collect()} == {(10, 100), (10, 115), (11, 101), (18, 111), (18, 115), (20, 100), (20, 115)}
    assert facts.reverse_links(papers.limit(0), debt, papers.limit(0)).count() == facts.reverse_links(papers, debt.limit(0), papers.limit(0)).count() == 0


def test_heads_bound_what_is_read(spark):
    late = spark.createDataFrame([(1, 1, "indenture", "Deed", "x" * 60_000 + " CUSIP 037833100 5.25% notes due 2036", None)], PAPERS)
    _, debt = book(spark)
    assert facts.reverse_links(late, debt, late.limit(0)).count() == 0
    assert {r.instrument_id for r in facts.reverse_links(late, debt, late.limit(0), heads=facts.WHOLE).collect()} == {100, 105, 106, 115}  # 5.26 less 5.25 is below 0.01 as doubles


def test_company_links_fall_back_to_footnotes(spark):
    papers, debt = book(spark)
    notes = spark.createDataFrame([(1, 50, "The senior notes due 2036 bear 5.25% interest. " + "More. " * 20), (2, 51, "senior notes due 2036, 5.25% " * 9)], "company_id int, doc_id int, content string")
    free = papers.where("doc_id <> 15")
    links = facts.company_links(debt, free, notes, F.lit(DAY(2024, 1, 1)))
    got = {(r.instrument_id, r.doc_id): (r.score, r.source) for r in links.collect()}
    assert got[105, 50] == (0.65, "footnote")
    assert got[111, 18] == (0.95, "credit_agreement")
    assert got[100, 10][0] == 0.95
    assert (113, 10) not in got
    assert (112, 10) not in got
    report = {r.company_id: (r.instruments, r.high, r.low, r.unmatched) for r in facts.link_report(debt, links).collect()}
    best = {}
    for (i, _), (s, _) in got.items():
        best[i] = max(best.get(i, 0), s)
    active = [r.id for r in debt.where("is_active and company_id = 1").collect()]
    high = sum(best.get(i, 0) >= linking.SURE for i in active)
    assert report[1] == (len(active), high, sum(i in best for i in active) - high, sum(i not in best for i in active))
    assert report[None] == (1, 0, 0, 1)


def test_numbers_of_issuers_are_no_years(spark):
    said = "Indenture between Acme Holdings 2015, as Issuer, and the Bank. Final payment in 2019. " + "It is so agreed. " * 8
    papers = spark.createDataFrame([(1, 10, "indenture", "Deed", said, DAY(2001, 1, 1))], PAPERS)
    rows = [(1, i, "senior_notes", 500, DAY(1999, 1, 1), DAY(y, 5, 1), True, 5, 5, "Paper", "x", None, "Acme Holdings 2015 Inc.") for i, y in ((1, 2015), (2, 2019))]
    debt = spark.createDataFrame(rows, DEBT)
    assert [r.instrument_id for r in facts.company_links(debt, papers, papers, F.lit(DAY(2024, 1, 1))).collect()] == [2]
    assert [r.instrument_id for r in facts.reverse_links(papers, debt, papers.limit(0)).collect()] == [2]


def test_rates_of_links_stand_alone_and_two_points_are_too_many(spark):
    notes = "The senior notes due 2036 bear 15.25% interest. " + "More. " * 20
    papers = spark.createDataFrame([(1, 10, "indenture", "6.57% Notes due 2036", "x", DAY(2001, 1, 1))], PAPERS)
    rows = [(1, i, "senior_notes", bps, DAY(1999, 1, 1), DAY(2036, 5, 1), True, 5, 5, "Paper", "x", None, "Zeta") for i, bps in ((1, 525), (2, 659), (3, 658))]
    debt = spark.createDataFrame(rows, DEBT)
    papers = papers.withColumn("content", F.lit("6.57% notes due 2036"))
    footnotes = spark.createDataFrame([(1, 50, notes)], "company_id int, doc_id int, content string")
    links = facts.company_links(debt, papers, footnotes, F.lit(DAY(2024, 1, 1)))
    assert [(r.instrument_id, r.score) for r in links.collect()] == [(3, 0.78)]


def test_bond_links_are_worked_out_once(spark, monkeypatch):
    kept, written = [], facts.written
    monkeypatch.setattr(facts, "written", lambda df, name: kept.append(name) or written(df, name))
    debt = spark.createDataFrame([(1, 1, "senior_notes", 525, True)], "id int, company_id int, instrument_type string, rate_bps int, is_active boolean").selectExpr(
        "*", "date'2020-01-01' as issue_date", "date'2030-01-01' as maturity_date", "cast(null as bigint) as outstanding", "cast(null as bigint) as principal", "'x' as name", "'037833EQ9' as cusip", "cast(null as string) as isin", "'Zeta Corp' as issuer")
    papers = spark.createDataFrame([(7, 1, "indenture", "Deed", "our 5.25% notes due 2030 and more"), (8, 1, "indenture", "Deed", "none")], "doc_id int, company_id int, kind string, title string, content string").selectExpr("*", "date'2024-01-01' as filed")
    links = facts.company_links(debt, papers, papers, F.expr("date'2024-01-01'"))
    assert kept == ["bond-links"]
    assert [(r.instrument_id, r.doc_id, r.score, r.source) for r in links.collect()] == [(1, 7, 0.8, "indenture")]


def test_few_facts_are_moved_and_near_days_meet_once(spark):
    papers, debt = book(spark)
    plan = facts.reverse_links(papers, debt, papers.where("doc_id = 20"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # below which the texts would lie
    assert plan.count("([0-9A-Z]{9})") == 1  # texts are read once
    sizes = [(r.instrument_id, len(r.facts)) for r in facts.instrument_facts(debt).collect()]
    assert max(n for _, n in sizes) <= 7  # one of each kind, and the notes of its name
    start = DAY(2020, 1, 1)
    days = [start + datetime.timedelta(k) for k in range(70)]
    papers = spark.createDataFrame([(1, i, "indenture", "Deed", "Issuer: Acme Widgets, dated as of " + f"{d:%B} {d.day}, {d.year}", d) for i, d in enumerate(days)], PAPERS)
    debt = spark.createDataFrame([(1, 1000 + i, "notes", None, d, None, True, None, None, None, None, None, "Acme Widgets" if i % 2 else "Zeta") for i, d in enumerate(days)], DEBT)
    found = facts.reverse_links(papers, debt, papers.limit(0))
    want = {}
    for i in range(70):
        for k in range(70):
            if abs(i - k) <= facts.NEAR_DAYS:
                issuer = (0.80 if i == k else 0.70) if k % 2 else 0
                want[i, 1000 + k] = max(issuer, 0.70 if i == k else 0.55), "issuer_issue_date" if issuer else "reverse_match"
    assert {(r.doc_id, r.instrument_id): (r.score, r.method) for r in found.collect()} == want
    assert max(r.n for r in facts.document_facts(papers, facts.WHOLE).selectExpr("size(facts) as n").collect()) <= 6


def test_the_query_reads_whole_texts(spark, monkeypatch):
    from ledgerline.plans import deeds

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, deeds.reverse_links(spark, sf).collect()))
    plain = deeds.deeds
    monkeypatch.setattr(deeds, "deeds", lambda s, d: plain(s, d).withColumn("content", F.concat(F.repeat(F.lit("So it is. "), 6_000), "content")))
    assert sorted(map(tuple, deeds.reverse_links(spark, sf).collect())) == want
    assert len(want) > 100
