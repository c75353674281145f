import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import dates, finance, identifiers, names
from ledgerline.operators import aggregates, graph, joins, matching, text, upsert
from ledgerline.operators.screen import BadRequest, NotFound, Screen, comma_list, key_kind, one, percent_to_bps
from ledgerline.sources import export, readers


def test_screen_rules(spark):
    df = spark.createDataFrame([(1, "Aa", 5, None), (2, "b%", None, 3), (3, None, 7, 3)], "id int, name string, amount int, x int")
    s = Screen(df, ("id",))
    assert [r.id for r in s.sort("-amount").page(10).collect()] == [3, 1, 2]
    assert [r.id for r in s.sort("nonsense").page(10).collect()] == [1, 2, 3]
    assert [r.id for r in s.present("x", True).between("x", 3, 3).page(10).collect()] == [2, 3]
    assert s.contains("name", "A").total() == 1
    assert s.envelope(1, 1)["meta"] == {"total": 3, "limit": 1, "offset": 1}
    with pytest.raises(BadRequest):
        s.fields("id,other")
    with pytest.raises(BadRequest):
        s.page(0)
    with pytest.raises(NotFound):
        one(df, "name", "zz")
    assert one(df, "name", "aa")["id"] == 1
    assert comma_list(" a, ,b ", upper=True) == ["A", "B"] and key_kind("12345678X") == "cusip"
    assert percent_to_bps(8.2) == 819 and percent_to_bps(4.35) == 434


def test_null_keys_never_match(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(str(r.k) for r in joins.anti(left, right, ["k"]).collect()) == ["2", "None"]
    assert [r.k for r in joins.semi(left, right, ["k"]).collect()] == [1]


def test_as_of_and_ties(spark):
    d = datetime.date
    left = spark.createDataFrame([("a", d(2024, 1, 5)), ("a", d(2024, 1, 1)), ("b", d(2024, 1, 9))], "k string, t date")
    right = spark.createDataFrame([("a", d(2024, 1, 5), 7), ("a", d(2024, 1, 2), 3)], "k string, u date, v int")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", d(2024, 1, 5)): 7, ("a", d(2024, 1, 1)): None, ("b", d(2024, 1, 9)): None}
    rows = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 4, "z")], "g int, o int, n string")
    assert joins.latest_ties(rows, ["g"], "o").count() == 2 and joins.latest_one(rows, ["g"], ["o"]).count() == 1


def test_traversal_stops_at_cycles_and_filters(spark):
    nodes = spark.createDataFrame([("a", None, True), ("b", "a", True), ("c", "b", False), ("d", "c", True), ("x", "y", True), ("y", "x", True)], "id string, parent_id string, ok boolean")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.descendants(nodes, start, 5).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {r.id for r in graph.descendants(nodes, start, 5, F.col("ok")).collect()} == {"b"}
    assert {r.id for r in graph.ancestors(nodes, spark.createDataFrame([("x",)], "id string"), 10).collect()} == {"y"}
    with pytest.raises(ValueError):
        graph.reach(nodes.toDF("src", "dst", "k"), start, 11)
    lines = spark.createDataFrame([(1, 0, 0, "r"), (1, 1, 2, "a"), (1, 2, 4, "b"), (1, 3, 2, "c")], "doc int, pos int, indent int, name string")
    assert {r.name: r.parent_pos for r in graph.hierarchy_from_indents(lines).collect()} == {"r": None, "a": 0, "b": 1, "c": 0}


def test_writes_are_idempotent(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    once = upsert.merged(new.limit(0), new, ["k"])
    twice = upsert.merged(once, new, ["k"])
    last = upsert.merged(twice, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    for path in ("a", "b"):  # a rerun writes the same rows to another place
        last.write.parquet(f"{tmp_path}/{path}")
        assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/{path}").collect()} == {(1, "a"), (2, "c")}
    old = spark.createDataFrame([(1, "a", False), (2, None, True)], "k int, v string, f boolean")
    up = spark.createDataFrame([(1, None, True), (2, "z", False), (3, "n", None)], "k int, v string, f boolean")
    assert {tuple(r) for r in upsert.filled(old, up, ["k"], ["f"]).collect()} == {(1, "a", True), (2, "z", True), (3, "n", False)}
    j = spark.createDataFrame([(1, '{"a":"1"}', True), (2, None, True)], "k int, j string, on boolean")
    got = upsert.flagged(j, F.col("k") == 1, "on", False, "j", {"why": "matured"}).orderBy("k").collect()
    assert (got[0].on, got[1].on) == (False, True) and '"why":"matured"' in got[0].j


def test_a_merge_holds_no_table_by_key(spark):
    columns = "v string, k int, j int, at int"
    old = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 1, 0), ("b", 2, 1, 9), ("c", None, 1, 0), ("d", 3, None, 0), ("b", 2, 1, 8)], columns)
    new = spark.createDataFrame([("x", 2, 1, 1), ("y", 2, 1, 3), ("z", None, 1, 1), ("z", None, 1, 0), ("w", 4, 4, None)], columns)
    got = upsert.merged(old, new, ["k", "j"], ["at"])
    assert got.columns == ["k", "j", "v", "at"]
    want = [(1, 1, "a", 0), (1, 1, "a", 0), (None, 1, "c", 0), (3, None, "d", 0), (2, 1, "y", 3), (None, 1, "z", 1), (4, 4, "w", None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert upsert.merged(old, new, ["k", "j"]).count() == 7
    plan = upsert.merged(old, new, ["k", "j"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@settings(max_examples=20, deadline=None)
@given(base=st.text(alphabet="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=8, max_size=8))
def test_check_digits_round_trip(spark, base):
    df = spark.createDataFrame([(base,)], "b string")
    cusip = identifiers.normal_cusip(F.col("b"))
    r = df.select(cusip.alias("c"), identifiers.is_cusip(cusip).alias("ok"), identifiers.is_isin(identifiers.cusip_to_isin(cusip)).alias("isin"), identifiers.isin_to_cusip(identifiers.cusip_to_isin(cusip)).alias("back")).first()
    assert r.ok and r.isin and r.back == r.c


def test_known_identifiers(spark):
    r = spark.sql("select '037833100' a, 'US0378331005' b, '037833101' c, cast(null as string) d").select(identifiers.is_cusip(F.col("a")), identifiers.is_isin(F.col("b")), identifiers.is_cusip(F.col("c")), identifiers.is_cusip(F.col("d"))).first()
    assert list(r) == [True, True, False, False]


def test_names_and_dates(spark):
    n = lambda x: spark.range(1).select(names.normal_name(F.lit(x))).first()[0]
    assert n("The ABC Corporation, Inc.") == "abc corporation inc" and n("XYZ  Holdings, L.L.C.") == "xyz holdings llc" and n("Foo Ltd.") == "foo ltd"
    r = spark.range(1).select(names.coupon_bps(F.lit("5 1/4% notes due 2030")), names.coupon_bps(F.lit("8.20% Senior Notes")), names.maturity_year(F.lit("notes due March 2031")), names.instrument_type(F.lit("Revolving Credit Facility")), names.slug(F.lit(" A & B -- c"))).first()
    assert list(r) == [525, 820, 2031, "revolver", "a-b-c"]
    got = spark.createDataFrame([("2024-02-29",), ("03/04/2024",), ("March 5, 2024",), ("2027",), ("junk",), (None,)], "t string").select(dates.parse_date(F.col("t"))).collect()
    d = datetime.date
    assert [x[0] for x in got] == [d(2024, 2, 29), d(2024, 3, 4), d(2024, 3, 5), d(2027, 12, 31), None, None]
    assert spark.range(1).select(names.clean_html(F.lit("<p>a &amp; b</p><script>x</script><div>c</div>"))).first()[0] == "a & b\nc"


def test_yield_inverts_price(spark):
    df = spark.createDataFrame([(0.05, 0.07, 3.2), (0.0, 0.01, 10.0), (0.12, 0.0, 0.3), (0.04, -0.01, 5.0)], "c double, y double, t double")
    p = df.withColumn("p", finance.price_from_yield(F.col("c"), F.col("y"), F.col("t")))
    for r in p.withColumn("back", finance.yield_to_maturity("p", "c", "t")).collect():
        assert abs(r.back - r.y) < 1e-6
    r = spark.range(1).select(finance.normal_rating(F.lit(" ba1 ")), finance.rating_bucket(F.lit("A-")), finance.benchmark_tenor(F.lit(4.5)), finance.spread_bps(F.lit(5.219), F.lit(5.0)), finance.safe_ratio(F.lit(0.0), F.lit(2.0))).first()
    assert list(r) == ["BB+", "IG", "5Y", 21, None]


def test_text_operators(spark):
    docs = spark.createDataFrame([(1, "Senior notes are issued"), (2, "the note of a bank"), (3, ""), (4, None)], "doc_id long, text string")
    index = text.inverted_index(docs)
    assert {r.doc_id for r in text.search(index, "the notes").collect()} == {1, 2}
    assert docs.where(text.matches_all(F.col("text"), F.lit("issuing notes"))).count() == 1
    assert "<b>notes</b>" in docs.where("doc_id = 1").select(text.snippet(F.col("text"), F.lit("note"))).first()[0]
    r = spark.range(1).select(text.amounts_cents(F.lit("$1.5 billion and $2,000")), text.coupons(F.lit("5.25% and 30.5%"))).first()
    assert r[0] == [150000000000, 200000] and r[1] == [5.25]
    md = spark.createDataFrame([(1, "# T\nintro\n## One\nbody\n## Skip\nx")], "k long, md string")
    assert [x.heading for x in text.markdown_chunks(md, "k", "md", ("Skip",)).collect()] == ["One"]
    a = spark.createDataFrame([(1, "Acme Holdings Inc")], "id int, left_name string")
    b = spark.createDataFrame([("ACME Holdings, LLC",), ("Acme Bank",)], "right_name string")
    assert [x.right_name for x in matching.fuzzy_join(a, b, "left_name", "right_name", "id").collect()] == ["ACME Holdings, LLC"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Date,1 Mo,2 Mo,10 Yr\n01/02/2024,5.5,5.4,3.9\n01/03/2024,N/A,,4.0\nbad,1,1,1\n")
    rows = readers.read_curve(spark, f"file://{tmp_path}/c.csv")
    assert rows.count() == 3 and {r.benchmark for r in readers.latest_curve(rows).collect()} == {"1M", "10Y"}
    j = spark.createDataFrame([("b", '{"t":[0,86400],"c":[1.5,null],"v":[3]}')], "k string, j string")
    assert [tuple(r) for r in readers.candle_rows(j, "k", "j").collect()] == [("b", datetime.date(1970, 1, 1), 1.5, 3.0)]
    h = spark.createDataFrame([(1, "<table><tr><td></td><td>&nbsp;</td><td>Sub <b>LLC</b></td><td>DE</td></tr><tr><td></td></tr></table>")], "k int, h string")
    assert [(r.indent, r.cells) for r in readers.table_cells(h, "k", "h").collect()] == [(2, ["Sub LLC", "DE"])]
    nested = spark.sql("select 1 as b, named_struct('y', 2, 'x', named_struct('z', 3)) as a")
    assert export.flat(nested).columns == ["a_x_z", "a_y", "b"]
    tag = export.result_tag(nested)
    assert tag == export.result_tag(nested.union(nested).limit(1)) and export.unchanged(tag, f'"x", W/"{tag}"') and export.unchanged("q", "*")


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 4), (1, 2), (1, 9), (1, 7), (2, None)], "g int, v int")
    got = {r.g: r.m for r in df.groupBy("g").agg(aggregates.upper_median(F.col("v")).alias("m")).collect()}
    assert got == {1: 7, 2: None}
    r = spark.range(1).select(aggregates.period_change(F.lit(5), F.lit(0)), aggregates.period_change(F.lit(0), F.lit(0)), aggregates.trend(F.lit(-11.0))).first()
    assert list(r) == [100.0, 0.0, "decreasing"]
