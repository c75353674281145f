"""Queries of sources and sinks: what is read out of wide files and JSON, and keyed writes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import AS_OF, table, view
from ..durable import run_dir
from ..operators import upsert
from ..sources import export, readers
from .registry import query

POINTS = """
    select cast(ts as date) as yield_date, cast(case when event_type = 'view' then '1M' when event_type = 'click' then '10Y' end as varchar) as benchmark, cast(count(*) as decimal(6, 4)) as yield_pct
    from events where event_type in ('view', 'click') group by cast(ts as date), event_type"""


def wide_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve file: a row per day, a column per tenor, blanks and N/A where there is none."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    cell = lambda x, none: F.when(x > 0, F.format_string(" %.2f", x.cast("double"))).otherwise(none)
    return days.agg(n("view").alias("v"), n("click").alias("c")).select(F.date_format("d", "MM/dd/yyyy").alias("Date"), cell(F.col("v"), "N/A").alias("1 Mo"), cell(F.col("c"), "").alias("10 Yr"), F.lit("9.99").alias("Other"))


@query(POINTS)
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "curve")
    wide_curve(spark, sf_dir).write.option("header", True).csv(folder)
    return readers.read_curve(spark, folder)


@query(f"select benchmark, max(yield_date) as yield_date, max_by(yield_pct, yield_date) as yield_pct from ({POINTS}) p group by benchmark")
def curve_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.latest_curve(readers.curve_rows(wide_curve(spark, sf_dir)))


@query("select instrument_id, price_date as day, cast(price_cents as double) as close, cast(volume as double) as volume from prices where instrument_id % 3 <> 1")
def candle_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "prices")
    x = F.sort_array(F.collect_list(F.struct(F.unix_seconds(F.col("price_date").cast("timestamp")).alias("t"), F.when(F.col("instrument_id") % 3 != 1, F.col("price_cents").cast("double")).alias("c"), F.col("volume").cast("double").alias("v"))))
    packed = rows.groupBy("instrument_id").agg(x.alias("x"))
    form = {"ignoreNullFields": "false"}
    return readers.candle_rows(packed.select("instrument_id", F.to_json(F.struct(F.col("x.t").alias("t"), F.col("x.c").alias("c"), F.col("x.v").alias("v")), form).alias("json")), "instrument_id", "json")


@query("""
    select cast(ts as date) as yield_date, event_type as benchmark, cast(count(*) as double) as yield_pct from events where cast(ts as date) is not null group by cast(ts as date), event_type""")
def curve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"), "event_type").count()
    days = n.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("count").cast("double")))).alias("rates"))
    good = F.struct(F.col("d").cast("string").alias("date"), "rates")
    bad = F.struct(F.lit("not a day").alias("date"), "rates")
    return readers.curve_maps(days.select(F.to_json(F.array(good, bad)).alias("json")), "json")


@query("select c_custkey as id, case o_orderkey % 3 when 0 then '10-K' else '10-Q' end as form, cast(o_orderdate as date) as filed, cast(o_orderkey as varchar) as accession from customer join orders on o_custkey = c_custkey where o_orderkey % 3 < 2 and cast(o_orderdate as date) >= DATE '1996-01-01' and o_orderkey % 11 <> 0")
def filing_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    form = F.when(k % 3 == 0, "10-K").when(k % 3 == 1, "10-Q").otherwise("8-K")
    filed = F.when(k % 11 == 0, "pending").otherwise(F.to_date("o_orderdate").cast("string"))
    x = F.collect_list(F.struct(form.alias("form"), filed.alias("filed"), k.cast("string").alias("accession")))
    packed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(x.alias("x"))
    json = F.to_json(F.struct(F.col("x.form").alias("form"), F.col("x.filed").alias("filingDate"), F.col("x.accession").alias("accessionNumber")))
    return readers.filing_rows(packed.select("id", json.alias("json")), "id", "json", ("10-K", "10-Q"), "1996-01-01")


@query("""
    select doc_id, case when doc_id % 2 = 0 then '10-K' else '8-K' end as doc_type, DATE '2024-01-01' + cast(doc_id % 300 as int) as filed, case when doc_id % 3 = 0 then 'ex21' end as exhibit, cast(length(text) as bigint) as n_chars from documents where length(text) >= 500""")
def filing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("_", F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("8-K"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string"), F.when(F.col("doc_id") % 3 == 0, "ex21"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", key.alias("name"))
    # the name is the key; rows come back to their documents by it and the text's length
    found = readers.keyed_filings(rows.select(F.concat_ws("/", "name", F.col("doc_id").cast("string")).alias("name"), "text"), "name", "text", 500)
    return found.select(F.substring_index("name", "/", -1).cast("long").alias("doc_id"), "doc_type", "filed", F.nullif(F.substring_index("exhibit", "/", 1), F.lit("")).alias("exhibit"), F.length("text").cast("long").alias("n_chars")).withColumn("exhibit", F.when(F.col("exhibit") == "ex21", "ex21"))


@query("""
    select lower(trim(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))) as bare_name, array_to_string(list_sort(list(distinct 'LEI' || p_partkey)), ',') as leis from part where p_partkey % 9 <> 0 group by 1""")
def lei_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lei = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("LEI"), F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.upper("p_name"), F.lit(", Inc.")).alias("name"), lei.alias("lei"))
    return readers.lei_index(rows, "name", "lei").select("bare_name", F.array_join("leis", ",").alias("leis"))


@query("""
    with l as (select o_custkey as child, o_orderkey as parent, o_orderkey % 2 as direct, cast(o_orderdate as date) as day from orders where o_orderstatus <> 'F'),
         r as (select *, row_number() over (partition by child, direct order by day desc, parent desc) as nth from l)
    select child, max(case when direct = 1 then parent end) as direct, max(case when direct = 0 then parent end) as ultimate from r where nth = 1 group by child""")
def lei_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 1, "IS_DIRECTLY_CONSOLIDATED_BY").otherwise("IS_ULTIMATELY_CONSOLIDATED_BY")
    status = F.when(F.col("o_orderstatus") == "F", "LAPSED").otherwise("ACTIVE")
    updated = F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("parent"))
    return readers.lei_parents(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent"), kind.alias("kind"), status.alias("status"), updated.alias("updated")))


@query("select id, ticker, country from companies")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "csv")
    rows = view(spark, sf_dir, "companies")
    export.write_csv(rows.select("id", F.struct("ticker", "country").alias("about")), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.select(F.col("id").cast("long").alias("id"), F.col("`about.ticker`").alias("ticker") if "about.ticker" in back.columns else F.col("about_ticker").alias("ticker"), F.col("`about.country`").alias("country") if "about.country" in back.columns else F.col("about_country").alias("country"))


@query("select id, cusip, outstanding from instruments order by id limit 500")
def bulk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "bulk")
    export.bulk(view(spark, sf_dir, "instruments").select("id", "cusip", "outstanding"), ("id",), 500, folder, "json")
    return spark.read.schema("id long, cusip string, outstanding long").json(folder)


@query("""select id, md5('{"cusip":"' || cusip || '","id":' || id || case when outstanding is null then '' else ',"outstanding":' || outstanding end || '}') as tag from instruments""")
def row_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "instruments").select("id", export.row_tag("outstanding", "id", "cusip").alias("tag"))


@query("""
    select instrument_id, price_date, price_cents from prices where price_date < DATE '1997-01-01' and instrument_id % 3 <> 0
    union all select instrument_id, price_date, price_cents + 1 from prices where instrument_id % 3 = 0 and price_date >= DATE '1996-01-01'""")
def replace_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "prices").select("instrument_id", "price_date", "price_cents")
    new = rows.where("instrument_id % 3 = 0 and price_date >= DATE '1996-01-01'").withColumn("price_cents", F.col("price_cents") + 1)
    every = rows.select("instrument_id").distinct().where("instrument_id % 3 = 0")
    old = rows.where("price_date < DATE '1997-01-01'").join(every.join(new.select("instrument_id").distinct(), "instrument_id", "left_anti"), "instrument_id", "left_anti")
    return upsert.replaced(old, new, ["instrument_id"])


@query("select instrument_id, price_date, case when price_date < DATE '1996-01-01' then price_cents else price_cents + 5 end as price_cents from prices")
def append_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "prices").select("instrument_id", "price_date", "price_cents")
    new = rows.withColumn("price_cents", F.col("price_cents") + 5)
    return upsert.appended_once(rows.where("price_date < DATE '1996-01-01'"), new.unionByName(new.limit(100)), ["instrument_id", "price_date"])


@query(f"""
    select id, case when maturity_date < {AS_OF} then false else is_active end as is_active,
           case when maturity_date < {AS_OF} then '{{"a":"1","why":"matured"}}' when id % 2 = 0 then null else '{{"a":"1","why":"new"}}' end as facts from instruments""")
def flag_matured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "instruments").select("id", "is_active", "maturity_date", F.when((F.col("id") % 2 == 1) | (F.col("maturity_date") < F.expr(AS_OF)), '{"a":"1","why":"new"}').alias("facts"))
    return upsert.flagged(rows, F.col("maturity_date") < F.expr(AS_OF), "is_active", False, "facts", {"why": "matured"}).drop("maturity_date")


@query("select id, 'stays' as side from instruments where not coalesce(outstanding > 10000000, false) union all select id, 'goes' from instruments where outstanding > 10000000")
def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays, goes = upsert.removed(view(spark, sf_dir, "instruments"), F.col("outstanding") > 10_000_000)
    return stays.select("id", F.lit("stays").alias("side")).unionByName(goes.select("id", F.lit("goes").alias("side")))


@query("""
    with d as (select company_id, count(*) as n, sum(coalesce(outstanding, principal, 0)) as total from instruments where is_active group by company_id),
         e as (select company_id, count(*) as n from entities where company_id is not null group by company_id)
    select c.id as company_id, cast(e.n as int) as n_entities, cast(d.n as int) as n_debt, cast(d.total as bigint) as total_debt from companies c left join d on d.company_id = c.id left join e on e.company_id = c.id where c.id % 7 <> 0""")
def daily_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = view(spark, sf_dir, "companies").select(F.col("id").alias("company_id"))
    old = firms.where("company_id % 7 = 0").withColumn("snapshot_date", F.lit("1998-01-01").cast("date"))
    rows = export.snapshot(firms, view(spark, sf_dir, "entities").where("company_id is not null"), view(spark, sf_dir, "instruments"), "1998-01-01", old)
    return rows.select("company_id", F.when(F.col("entities").isNotNull(), F.size("entities")).alias("n_entities"), F.when(F.col("debt").isNotNull(), F.size("debt")).alias("n_debt"), "total_debt")
