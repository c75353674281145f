"""Scores of register entries and fallback links on planted rows."""

import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerline.operators import documents, linking, ownership


def test_places(spark):
    cases = [("Delaware, United States", "us", None, True), ("England", "gb", "", True), ("England", "fr", "Wales", True), ("Cayman Islands", "ky", "KY", True), ("Paris", "fr", "France", False), (None, "us", "us", False), ("Texas", None, "us-de", True)]
    df = spark.createDataFrame(cases, "a string, b string, c string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", ownership.same_place(F.col("a"), F.col("b"), F.col("c"))).collect())


def test_register_matches_against_all_pairs(spark):
    names = ["Acme Holdings Inc", "Holdings Acme LLC", "Acme Bank", "Acmee Holding", "Zeta Energy Partners", "Energy Partners Zeta LP", "", None, "Delta"]
    entities = [(i, n, "Texas" if i % 2 else None) for i, n in enumerate(names)]
    entries = [(f"L{i}", n, "US" if i % 3 else "GB", None, "ISSUED" if i % 2 else "LAPSED") for i, n in enumerate(reversed(names))]
    e = spark.createDataFrame(entities, "id int, name string, jurisdiction string")
    r = spark.createDataFrame(entries, "lei string, name string, country string, jurisdiction string, status string")
    words = {n: x for n, x in spark.createDataFrame([(n,) for n in names if n is not None], "n string").select("n", ownership.sorted_words(F.col("n"))).collect()}
    want = {}
    for i, n, place in entities:
        scored = []
        for lei, other, country, _, status in entries:
            if words.get(n) and words.get(other):
                score = 0.7 * SequenceMatcher(None, words[n], words[other]).ratio() + 0.2 * (place is not None and country == "US") + 0.1 * (status == "ISSUED")
                scored.append((-round(score, 6), lei))
        if scored and -min(scored)[0] >= 0.85:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert want and {x.id: (x.lei, x.score) for x in ownership.register_matches(e, r).collect()} == want


def test_register_parents_stay_in_the_company(spark):
    matches = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, lei string")
    parents = spark.createDataFrame([("A", "P", "Q"), ("B", None, "P"), ("C", "C", None)], "child string, direct string, ultimate string")
    register = spark.createDataFrame([("P", "Parent Group Inc"), ("Q", "Other"), ("C", "Child Three")], "lei string, name string")
    entities = spark.createDataFrame([(1, 10, "One"), (2, 20, "Two"), (3, 30, "Child Three"), (4, 10, "Parent Groop"), (5, 30, "Parent Group")], "id int, company_id int, name string")
    got = ownership.register_parents(matches, parents, register, entities).collect()
    assert [tuple(r) for r in got] == [(1, 4, "P")]


def test_evidence(spark):
    rows = [('{"gleif_lei": "X"}', 5, False, False, "attribute:gleif_lei"), ('{"gleif_lei": ""}', 2, True, False, "structure_tier:2"), (None, None, True, True, "is_guarantor"), ("no json", 3, None, True, "is_borrower"), ("{}", 3, False, None, None)]
    df = spark.createDataFrame(rows, "a string, t int, g boolean, b boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", ownership.entity_evidence(*[F.col(c) for c in "atgb"])).collect())
    links = spark.createDataFrame([('{"source": "exhibit_21"}', False), ('{"source": "10-K"}', True), ('{"psc_name": "J"}', True), (None, False)], "a string, want boolean")
    assert all(r.got == r.want for r in links.withColumn("got", ownership.link_evidence(F.col("a"))).collect())


def test_fallback_links(spark):
    pad = " z" * 60
    texts = [("5.25% Senior Notes due 2027" + pad, True), ("due 2027 the 5.25 % notes" + pad, True), ("5.25% loans" + " z" * 120 + " notes 2027", False), ("notes of 2027" + " z" * 40 + " 5.25%" + pad, False), ("15.25% notes 2027" + pad, True), ("5.2% notes 2027" + pad, False), ("5.25% notes 2027", False), (None, False)]
    notes = spark.createDataFrame([(1, i, t) for i, (t, _) in enumerate(texts)], "company_id int, doc_id int, content string")
    debt = spark.createDataFrame([(1, 1, 525, "x"), (1, 2, 0, "5.25% Notes due 2027"), (1, 3, 525, "no year")], "company_id int, id int, rate_bps int, name string")
    debt = debt.withColumn("maturity_date", F.when(F.col("id") == 1, F.lit("2027-05-01").cast("date")))
    got = {(r.instrument_id, r.doc_id) for r in linking.footnote_links(debt, notes, 9).collect()}
    assert got == {(k, i) for k in (1, 2) for i, (_, hit) in enumerate(texts) if hit}
    assert linking.footnote_links(debt, notes, 1).count() == 2
    plain = spark.range(1).select(linking.plain_score(F.lit("senior notes"), F.lit("Zeta Senior Notes"), F.lit("indenture"), F.lit("zeta senior notes")).alias("s")).first().s
    assert abs(plain - (0.2 + 0.3)) < 1e-9
    ranks = [("Base Indenture", "unlimited as to aggregate principal", 2), ("Indenture", "x" * 20001, 2), ("Supplemental Indenture", "base indenture", 1), ("Indenture", None, 1), ("Officer Indenture", "x", None), ("Notes", "base indenture", None), (None, None, None)]
    df = spark.createDataFrame(ranks, "t string, c string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", linking.indenture_rank(F.col("t"), F.col("c"))).collect())


def test_tree_documents(spark):
    rows = [("a", None, "A"), ("c", "a", None), ("b", "a", 'B "x"'), ("d", "b", "D"), ("e", "d", "E"), ("r1", "r2", "R"), ("r2", "r1", "R"), ("z", None, "Z")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, name string")

    def tree(key, depth):
        own = {"id": key} | {"name": n for i, _, n in rows if i == key and n is not None}
        return own | {"children": [tree(i, depth - 1) for i, p, _ in sorted(rows, key=lambda x: x[0]) if p == key and depth > 0]}

    for levels in (0, 2, 4):
        got = {r.id: json.loads(r.document) for r in documents.tree_documents(nodes, ["name"], levels).collect()}
        assert got == {k: tree(k, levels) for k in ("a", "z")}
    assert documents.tree_documents(nodes.limit(0), ["name"], 1).count() == 0


def test_all_links_by_the_strongest_signal(spark):
    bond = (1, 1, "037833EQ9", "senior_notes", "2020-01-10", "Zeta Energy Corp", 525, "2030-05-01", 50_000_000_00, None, "x")
    loan = (1, 2, None, "term_loan_b", None, None, None, None, None, 10_000_000_00, None)
    columns = "company_id int, id int, cusip string, instrument_type string, issued string, issuer string, rate_bps int, matures string, outstanding long, principal long, name string"
    debt = spark.createDataFrame([bond, loan], columns).withColumn("issue_date", F.col("issued").cast("date")).withColumn("maturity_date", F.col("matures").cast("date"))
    cases = [
        ("Indenture", "CUSIP 037833EQ9", None, 0.95), ("5.25% Senior Notes due May 1, 2030", "", None, 0.90), ("Indenture", "our 5.250% notes due 2030", None, 0.80), ("Indenture", "5.26% Notes due 2030", None, 0.78),
        ("Amended Indenture", "", "2020-01-10", 0.85), ("Indenture", "", "2020-01-15", 0.75), ("Supplement", "Zeta Energy pays in 2030", None, 0.65), ("Indenture", "a rate of 5.25% until 2030", None, 0.55),
        ("Indenture", "about $51 million", None, 0.45), ("Indenture", "5.25% in 2030, $50 million", None, 0.65), ("Indenture", "CUSIP 037833EQ9 5.25% in 2030, $50 million", None, 0.90), ("Indenture", "nothing", "2021-01-01", None), (None, None, None, None),
    ]
    papers = spark.createDataFrame([(1, i, "indenture", t, c, f) for i, (t, c, f, _) in enumerate(cases)], "company_id int, doc_id int, kind string, title string, content string, day string").withColumn("filed", F.col("day").cast("date"))
    got = {r.doc_id: (r.score, r.relationship) for r in linking.all_links(debt, papers, F.lit("2024-01-01").cast("date")).where("instrument_id = 1").collect()}
    assert {k: v[0] for k, v in got.items()} == {i: s for i, (_, _, _, s) in enumerate(cases) if s}
    assert (got[4][1], got[6][1], got[0][1]) == ("amends", "supplements", "governs")
    deal = papers.limit(1).withColumns({"kind": F.lit("credit_agreement"), "title": F.lit("Term Loan Credit Agreement"), "content": F.lit("a term loan"), "filed": F.lit("2023-06-01").cast("date")})
    assert [r.score for r in linking.all_links(debt, deal, F.lit("2024-01-01").cast("date")).where("instrument_id = 2").collect()] == [0.55]
