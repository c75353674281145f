"""Results with drifting fields, refreshed documents, and functions in SQL."""

import datetime

from pyspark.sql import functions as F

from ledgerline.functions import sql
from ledgerline.operators import graph, refresh, text
from ledgerline.sources import results


def test_drifting_results(spark):
    rows = [
        (1, '{"entities": [{"entity_name": "A", "owners": [{"parent_name": "P"}], "is_guarantor": true}, {"type": "x"}, "B", null], "debt": []}'), (2, '{"company": {"entities": [{"name": "C", "guarantor": "yes"}]}, "instruments": {"name": "no list"}}'),
        (3, '{"debt_instruments": [{"name": 7, "amount": "1,000"}, {"name": "N", "outstanding_amount": 12.345, "rate_bps": 525.0, "maturity": "2030-02-30", "guarantors": ["g", 1]}]}'), (4, None), (5, ""), (6, "{"), (7, "3"), (8, "{}"), (9, '{"debt": [{"name": "D", "outstanding": 1e30, "maturity_date": "2031-01-31"}]}'),
    ]
    read = results.parsed_results(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    assert {(r.id, r.pos, r.name, r.entity_type, r.parent, r.is_guarantor) for r in results.entities(read, "id").collect()} == {(1, 0, "A", None, "P", True), (2, 0, "C", None, None, True)}
    found = {(r.id, r.pos): (r.name, r.outstanding and float(r.outstanding), r.rate_bps, r.maturity, r.guarantors) for r in results.instruments(read, "id").collect()}
    assert found == {(3, 0): ("7", None, None, None, None), (3, 1): ("N", 12.35, 525, None, ["g", "1"]), (9, 0): ("D", None, None, datetime.date(2031, 1, 31), None)}
    status = {r.id: (r.status, r.entities, r.instruments) for r in results.load_summary(read, "id").collect()}
    assert status == {1: ("loaded", 1, 0), 2: ("loaded", 1, 0), 3: ("loaded", 0, 2), 4: ("empty", 0, 0), 5: ("empty", 0, 0), 6: ("not_json", 0, 0), 7: ("not_object", 0, 0), 8: ("nothing_found", 0, 0), 9: ("loaded", 0, 1)}


def test_only_changed_companies_are_built(spark):
    debt = spark.createDataFrame([(1, 10, 5), (1, 11, None), (2, 20, 7), (3, 30, 9), (None, 40, 1)], "company_id int, id int, outstanding long")
    built = []

    def build(tables):
        rows = tables["debt"].groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("id", "outstanding"))).alias("x"))
        built.append({r.company_id for r in rows.collect()})
        return rows.select("company_id", F.to_json("x").alias("document"))

    def run(stored, now):
        rows = refresh.refreshed(stored, {"debt": (now, "company_id")}, build)
        got = {r.company_id: r.document for r in rows.collect()}
        full = {r.company_id: r.document for r in build({"debt": now.where("company_id is not null")}).collect()}
        assert got == full
        built.pop()
        return spark.createDataFrame(rows.select("company_id", "document", "digest").collect(), "company_id int, document string, digest string")

    stored = run(spark.createDataFrame([], "company_id int, document string, digest string"), debt)
    assert built.pop() == {1, 2, 3}
    stored = run(stored, debt.repartition(3).orderBy(F.desc("id")))  # another order is no change
    assert built.pop() == set()
    changed = debt.where("id <> 20").withColumn("outstanding", F.when(F.col("id") == 11, 0).otherwise(F.col("outstanding"))).union(spark.createDataFrame([(4, 41, 2)], "company_id int, id int, outstanding long"))
    stored = run(stored, changed)  # 1: null became 0; 2 is gone; 4 is new
    assert built.pop() == {1, 4}
    run(stored, changed.union(changed.where("id = 30")))  # a row that repeats
    assert built.pop() == {3}


def test_functions_in_sql(spark):
    sql.register(spark)
    one = spark.sql("select margin_pct(1, 3) a, margin_pct(1, 0) b, safe_ratio(5, 0) c, free_cash_flow(10, -3) d, free_cash_flow(10, null) e, spread_in_bps(4.0, 4.555) f, rating_band('BBB-') g, price_of_yield(0.05, 0, 1) h").first()
    assert tuple(one) == (33.33, None, None, 7, 10, -55, "IG", 107.5)
    md = spark.createDataFrame([(1, "# T\nintro\n## One\nbody one\n## \nempty\n## Two\nbody"), (2, "no headings"), (3, None)], "id int, md string")
    by_sql = spark.sql("select id, c.* from {md}, lateral heading_chunks(md) c", md=md)
    assert {(r.id, r.pos, r.heading, r.chunk) for r in by_sql.collect()} == {(r.id, r.pos, r.heading, r.chunk) for r in text.markdown_chunks(md, "id", "md").collect()}
    lines = spark.createDataFrame([(d, i, (i * 5 + d) % 4, "n") for d in range(6) for i in range(20)], "doc bigint, pos int, indent int, name string").repartition(3)
    tree = spark.sql("select * from parents_by_indent(table({lines}) partition by doc order by pos)", lines=lines)
    assert {(r.doc, r.pos, r.parent_pos) for r in tree.collect()} == {(r.doc, r.pos, r.parent_pos) for r in graph.hierarchy_from_indents(lines).collect()}
    found = spark.sql("select k.* from values ('a note, a Note and notes'), (null) t(x), lateral keyword_windows(x, 'note', 2, 3) k").collect()
    assert [(r.pos, r.part) for r in found] == [(0, "a note, a"), (1, " Note an")]


def test_results_are_read_once_and_looked_up_in_their_row(spark):
    from ledgerline.operators import consistency

    good = '{"entities": [{"name": "Top, Inc.", "entity_type": "holdco"}], "debt": [{"name": "N", "issuer": "the TOP  Incorporated", "amount": 3}]}'
    read = results.parsed_results(spark.createDataFrame([(1, good), (1, good.replace("TOP", "Other")), (None, good), (2, "{")], "id int, text string"), "id", "text")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (consistency.consistency(read, "id"), consistency.issues(read, "id"), results.load_summary(read, "id"))]
    assert [(p.lower().count("parsejson"), "Join" in p, "Aggregate" in p) for p in plans] == [(1, False, False)] * 3
    assert sorted((r.id or 0, r.status, r.n) for r in consistency.consistency(read, "id").collect()) == [(0, "pass", 0), (1, "fail", 1), (1, "pass", 0), (2, "skip", 0)]
    assert [(r.id, r.issue, r.subject, r.named) for r in consistency.issues(read, "id").collect()] == [(1, "issuer", "N", "the Other  Incorporated")]
    assert sorted((r.id or 0, r.status, r.entities, r.instruments) for r in results.load_summary(read, "id").collect()) == [(0, "loaded", 1, 1), (1, "loaded", 1, 1), (1, "loaded", 1, 1), (2, "not_json", 0, 0)]
