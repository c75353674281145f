"""Queries of the analyses over a book, and of small relational shapes that requests need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import AS_OF, table, view
from ..functions import finance
from ..operators import aggregates, book
from .registry import query

TREASURY = (("3M", 5.1), ("6M", 5.0), ("1Y", 4.9), ("2Y", 4.6), ("3Y", 4.4), ("5Y", 4.2), ("7Y", 4.25), ("10Y", 4.3), ("20Y", 4.6), ("30Y", 4.5))
SPREADS = (("A", 1, 60), ("A", 5, 100), ("A", 10, 140), ("BB", 1, 250), ("BB", 5, 330), ("BB", 10, 400), ("NR", 1, 500), ("NR", 5, 500), ("NR", 10, 500))
LATEST = "latest as (select company_id, max_by(total_debt, fiscal_year * 4 + fiscal_quarter) as reported from financials group by company_id)"
SUMS = "sums as (select company_id, sum(coalesce(outstanding, 0)) as instruments from instruments where is_active group by company_id)"


def debt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = view(spark, sf_dir, "financials").groupBy("company_id").agg(F.max_by("total_debt", F.col("fiscal_year") * 4 + F.col("fiscal_quarter")).alias("reported"))
    sums = view(spark, sf_dir, "instruments").where("is_active").groupBy("company_id").agg(F.sum(F.coalesce("outstanding", F.lit(0))).alias("instruments"))
    return sums.join(reported, "company_id", "full_outer")


@query(f"""
    with {LATEST}, {SUMS}
    select company_id, cast(case when reported > 0 and coalesce(instruments, 0) = 0 then reported when reported > 0 and instruments < reported * 0.5 then reported else coalesce(instruments, 0) end as bigint) as total_debt from sums full join latest using (company_id)""")
def cached_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt_totals(spark, sf_dir).select("company_id", book.chosen_debt(F.col("instruments"), F.col("reported")).alias("total_debt"))


@query(f"""
    with {LATEST}, {SUMS}
    select company_id, round(cast(instruments as double) / reported, 6) as ratio from sums join latest using (company_id) where reported > 0 and instruments > 0 and (instruments > reported * 2000 or instruments < reported * 100)""")
def scale_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.scale_errors(debt_totals(spark, sf_dir), 2000, 100).select("company_id", F.round("ratio", 6).alias("ratio"))


@query("""
    with l as (select *, row_number() over (partition by company_id order by fiscal_year desc, fiscal_quarter desc) as nth from financials)
    select company_id, case when total_debt <> 0 and ebitda <> 0 then round_even(cast(total_debt as double) / ebitda, 2) end as leverage, case when ebitda <> 0 and interest_expense <> 0 then round_even(cast(ebitda as double) / interest_expense, 2) end as coverage,
           case when total_debt <> 0 and total_assets <> 0 then round_even(cast(total_debt as double) / total_assets * 100, 2) end as debt_pct from l where nth = 1""")
def latest_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("total_debt", "ebitda", "interest_expense", "total_assets"), F.col("fiscal_year") * 4 + F.col("fiscal_quarter"))
    rows = view(spark, sf_dir, "financials").groupBy("company_id").agg(newest.alias("x")).select("company_id", "x.*")
    ratio = lambda a, b, factor: finance.safe_ratio(F.col(a), F.col(b), factor)
    return rows.select("company_id", ratio("total_debt", "ebitda", 1.0).alias("leverage"), ratio("ebitda", "interest_expense", 1.0).alias("coverage"), ratio("total_debt", "total_assets", 100.0).alias("debt_pct"))


@query("""
    select i.company_id, cast(count(*) as bigint) as n_bonds, cast(count(*) filter (where i.cusip is null) as bigint) as n_no_cusip, cast(count(q.instrument_id) filter (where i.cusip is not null) as bigint) as n_priced,
           cast(count(*) filter (where i.cusip is not null and q.instrument_id is null) as bigint) as n_unpriced, cast(nullif(sum(floor(i.outstanding * q.price / 100)) filter (where i.cusip is not null and q.price <> 0 and i.outstanding <> 0), 0) as bigint) as market_value,
           round(sum(cast(q.ytm_bps as double) / 100 * i.outstanding) filter (where i.cusip is not null and q.ytm_bps <> 0) / sum(i.outstanding) filter (where i.cusip is not null and q.ytm_bps <> 0), 2) as ytm_pct
    from (select id, company_id, case when id % 29 <> 0 then cusip end as cusip, outstanding from instruments where is_active) i left join quotes q on q.instrument_id = i.id group by i.company_id""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").withColumn("cusip", F.when(F.col("id") % 29 != 0, F.col("cusip")))
    return book.pricing_summary(debt, view(spark, sf_dir, "quotes"))


@query(f"""
    select i.id, q.fetched from instruments i left join quotes q on q.instrument_id = i.id where i.is_active and i.maturity_date > {AS_OF} and i.rate_bps is not null
    and i.instrument_type in ('senior_notes', 'convertible_notes', 'senior_secured_notes') and (q.fetched is null or {AS_OF} - q.fetched >= 7)""")
def bonds_needing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.needing_prices(view(spark, sf_dir, "instruments"), view(spark, sf_dir, "quotes"), F.expr(AS_OF)).select("id", "fetched")


def values(rows: tuple) -> str:
    return ", ".join(str(r) for r in rows)


@query(f"""
    with treasury(benchmark, y) as (values {values(TREASURY)}), spreads(rating, tenor, s) as (values {values(SPREADS)}),
    b as (select id, rate_bps / 10000.0 as c, case when maturity_date > {AS_OF} then cast(maturity_date - {AS_OF} as double) / 365.25 end as t, case id % 3 when 0 then 'A' when 1 then 'BB' else 'NR' end as rating from instruments where maturity_date is not null),
    m as (select *, case when t <= 0.25 then '3M' when t <= 0.75 then '6M' when t <= 1.5 then '1Y' when t <= 2.5 then '2Y' when t <= 4 then '3Y' when t <= 6 then '5Y' when t <= 8.5 then '7Y' when t <= 15 then '10Y' when t <= 25 then '20Y' else '30Y' end as benchmark from b),
    k as (select m.*, (select s from spreads x where x.rating = m.rating and x.tenor = 1) as s1, (select s from spreads x where x.rating = m.rating and x.tenor = 5) as s5, (select s from spreads x where x.rating = m.rating and x.tenor = 10) as s10 from m),
    s as (select *, cast(floor(case when t <= 1 then s1 when t < 5 then s1 + (s5 - s1) * (t - 1) / 4 when t < 10 then s5 + (s10 - s5) * (t - 5) / 5 else s10 end) as int) as spread from k),
    y as (select s.*, cast(treasury.y as double) + cast(spread as double) / 100 as ytm from s left join treasury using (benchmark))
    select id, case when t is null then 'N/A' else benchmark end as benchmark, case when t is null then 0 else spread end as spread_bps, case when t is null then 0 else cast(trunc(ytm * 100) as int) end as ytm_bps,
           case when t is null then 100.0 else round(c * 50 * (1 - pow(1 + ytm / 200, -(floor(t * 2) + 1))) / (ytm / 200) + 100 * pow(1 + ytm / 200, -(floor(t * 2) + 1)), 3) end as price, case when t is null then 'high' when rating = 'A' then 'medium' else 'low' end as confidence from y""")
def estimated_bond_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "BB").otherwise("NR")
    bonds = view(spark, sf_dir, "instruments").where("maturity_date is not null").select("id", "rate_bps", "maturity_date", rating.alias("rating"))
    treasury, spreads = spark.createDataFrame(list(TREASURY), "benchmark string, yield_pct double"), spark.createDataFrame(list(SPREADS), "rating string, tenor int, spread int")
    return book.estimated_prices(bonds, treasury, spreads, F.expr(AS_OF)).select("id", "benchmark", "spread_bps", "ytm_bps", "price", "confidence")


@query("""
    with b as (select id, rate_bps, maturity_date from instruments where rate_bps > 0),
    p as (select p.instrument_id, p.price_date, b.rate_bps + p.instrument_id % 300 as y, cast(b.maturity_date - p.price_date as double) / 365.25 as t from prices p join b on b.id = p.instrument_id where b.maturity_date > p.price_date),
    m as (select *, case when t <= 0.25 then '3M' when t <= 0.75 then '6M' when t <= 1.5 then '1Y' when t <= 2.5 then '2Y' when t <= 4 then '3Y' when t <= 6 then '5Y' when t <= 8.5 then '7Y' when t <= 15 then '10Y' when t <= 25 then '20Y' else '30Y' end as benchmark from p)
    select instrument_id, price_date, cast(y as int) as ytm_bps, benchmark, case when benchmark <> '3Y' then cast(trunc((cast(y as double) / 100 - cast(month(price_date) as double)) * 100) as int) end as spread_bps from m""")
def history_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonds = view(spark, sf_dir, "instruments").where("rate_bps > 0").select("id", "rate_bps", "maturity_date")
    rows = view(spark, sf_dir, "prices").select(F.col("instrument_id").alias("id"), "price_date").join(bonds, "id").where("maturity_date > price_date")
    price = finance.price_from_yield(F.col("rate_bps") / 10_000, (F.col("rate_bps") + F.col("id") % 300) / 10_000, finance.years_between(F.col("price_date"), F.col("maturity_date")))
    priced = rows.select(F.col("id").alias("instrument_id"), "price_date", price.alias("price"))
    tenors = F.explode(F.array(*[F.lit(t) for t, _ in TREASURY if t != "3Y"]))
    curve = priced.select(F.col("price_date").alias("yield_date")).distinct().select("yield_date", tenors.alias("benchmark"), F.month("yield_date").alias("yield_pct"))
    return book.history_spreads(priced, bonds, curve).select("instrument_id", "price_date", "ytm_bps", "benchmark", "spread_bps")


@query("""
    with m as (select company_id, leverage_ratio as l, net_debt as d from metrics)
    select company_id, 'new_debt' as kind, cast(id as varchar) as key, cast(null as varchar) as previous, cast(null as varchar) as current from instruments where is_active and id % 10 = 0 and id % 10 <> 1
    union all select company_id, 'removed_debt', cast(id as varchar), null, null from instruments where not is_active and id % 10 <> 0
    union all select company_id, 'entity_added', id, null, null from entities where entity_type = 'opco' and company_id % 5 = 0
    union all select company_id, 'entity_removed', id, null, null from entities where entity_type = 'subsidiary' and company_id % 5 = 1
    union all select company_id, 'metric', 'total_debt', cast(d * 1000 as varchar), cast(d as varchar) from m where d * 999 > 10000000000
    union all select company_id, 'metric', 'leverage_ratio', cast(cast(l - company_id % 3 as bigint) as varchar), cast(cast(l as bigint) as varchar) from m where l <> 0 and l - company_id % 3 <> 0 and company_id % 3 > 0
    union all select company_id, 'metric', 'subordination_risk', case when company_id % 2 = 0 then 'high' end, 'high' from m where company_id % 2 = 1
    union all select i.company_id, 'pricing', cast(i.id as varchar), null, cast(q.ytm_bps as varchar) from instruments i join quotes q on q.instrument_id = i.id where i.is_active and i.id % 10 <> 0 and q.ytm_bps <> 0""")
def company_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt, firms, metrics = view(spark, sf_dir, "instruments"), view(spark, sf_dir, "entities").where("company_id is not null"), view(spark, sf_dir, "metrics")
    key = ["company_id", F.col("id").alias("key")]
    new_entities = firms.where("entity_type <> 'subsidiary' or company_id % 5 <> 1").select(*key)
    old_entities = firms.where("entity_type <> 'opco' or company_id % 5 <> 0").select(*key)
    now = metrics.select("company_id", F.col("net_debt").alias("total_debt"), F.col("leverage_ratio").cast("long").alias("leverage"), F.lit("high").alias("risk"))
    before = metrics.select("company_id", (F.col("net_debt") * 1000).alias("total_debt"), (F.col("leverage_ratio") - F.col("company_id") % 3).cast("long").alias("leverage"), F.when(F.col("company_id") % 2 == 0, "high").alias("risk"))
    return book.company_changes(debt.where("id % 10 <> 0").select(*key), debt.where("is_active").select(*key), old_entities, new_entities, before, now, view(spark, sf_dir, "quotes"))


@query("""
    select (select count(*) from instruments where is_active) as n_active, cast(count(*) as bigint) as n_prices, cast(count(distinct instrument_id) as bigint) as n_instruments, min(price_date) as first_day, max(price_date) as last_day from prices""")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = view(spark, sf_dir, "instruments").agg(F.count_if("is_active").alias("n_active"))
    stats = view(spark, sf_dir, "prices").agg(F.count(F.lit(1)).alias("n_prices"), F.count_distinct("instrument_id").alias("n_instruments"), F.min("price_date").alias("first_day"), F.max("price_date").alias("last_day"))
    return active.crossJoin(stats)  # one row each


@query("select company_id, max(created) as created from (select company_id, created from snapshots union all select company_id, created - 30 from snapshots) x where created <= DATE '1997-09-01' group by company_id")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "snapshots")
    every = rows.unionByName(rows.withColumn("created", F.date_sub("created", 30)))
    return book.latest_before(every, ["company_id"], "created", F.lit("1997-09-01").cast("date")).select("company_id", "created")


@query("select doc_id, cast(count(distinct instrument_id) as int) as n, array_to_string(list_sort(list(distinct instrument_id)), ',') as instruments from document_links group by doc_id")
def document_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.sort_array(F.collect_set("instrument_id"))
    return view(spark, sf_dir, "document_links").groupBy("doc_id").agg(F.size(ids).alias("n"), F.array_join(ids, ",").alias("instruments"))


@query("select g.instrument_id, e.id, e.name from guarantees g join entities e on e.id = g.guarantor_entity where e.entity_type = 'subsidiary' and e.is_guarantor")
def bond_guarantors(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = view(spark, sf_dir, "entities").where("entity_type = 'subsidiary' and is_guarantor").select("id", "name")
    links = view(spark, sf_dir, "guarantees").select("instrument_id", F.col("guarantor_entity").alias("id"))
    return links.join(firms, "id").select("instrument_id", "id", "name")


@query("""
    select company_id, cast(year(maturity_date) as int) as year, cast(sum(outstanding) as bigint) as due, string_agg(id || ':' || coalesce(cast(outstanding as varchar), '-'), ' ' order by id) as bonds from instruments where maturity_date is not null group by company_id, year(maturity_date)""")
def nested_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "instruments").where("maturity_date is not null").groupBy("company_id", F.year("maturity_date").alias("year"))
    nested = rows.agg(F.sum("outstanding").alias("due"), F.sort_array(F.collect_list(F.struct("id", "outstanding"))).alias("bonds"))
    text = F.transform("bonds", lambda b: F.concat(b["id"].cast("string"), F.lit(":"), F.coalesce(b["outstanding"].cast("string"), F.lit("-"))))
    return nested.select("company_id", "year", "due", F.array_join(text, " ").alias("bonds"))


@query("""
    with page as (select * from instruments order by outstanding desc nulls last, id limit 50 offset 100)
    select cast(count(*) as bigint) as n, cast(sum(outstanding) as bigint) as total, cast(min(rate_bps) as int) as low, cast(max(rate_bps) as int) as high from page""")
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = view(spark, sf_dir, "instruments").orderBy(F.col("outstanding").desc_nulls_last(), "id").offset(100).limit(50)
    return page.agg(F.count(F.lit(1)).alias("n"), F.sum("outstanding").alias("total"), F.min("rate_bps").alias("low"), F.max("rate_bps").alias("high"))


@query("select endpoint, cast(count(*) as bigint) as n, min(cost_cents) as low, round(avg(cost_cents), 6) as mean, max(cost_cents) as high, cast(sum(cost_cents) as bigint) as total from usage_log group by endpoint")
def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "usage_log").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.min("cost_cents").alias("low"), F.round(F.avg("cost_cents"), 6).alias("mean"), F.max("cost_cents").alias("high"), F.sum("cost_cents").alias("total"))


@query("select id, name, row_number() over (order by case when entity_type = 'holdco' then 0 else 1 end, name, id) as nth from entities where entity_type in ('holdco', 'finco')")
def roots_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "entities").where("entity_type in ('holdco', 'finco')").select("id", "name", (F.col("entity_type") != "holdco").alias("later"))
    return aggregates.numbered(rows, "later", "name", "id").drop("later")


@query("""
    with s as (select instrument_id, doc_id, 0 as p from document_links where relationship = 'governs' union all select instrument_id, doc_id, 1 from document_links where relationship = 'related' union all select id, id % 7, 2 from instruments),
    o as (select *, row_number() over (partition by instrument_id, doc_id order by p) as r from s), k as (select *, row_number() over (partition by instrument_id order by p, doc_id) as nth from o where r = 1)
    select instrument_id, doc_id, cast(p as int) as priority from k where nth <= 2""")
def documents_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "document_links")
    sources = [links.where(f"relationship = '{r}'").select("instrument_id", "doc_id") for r in ("governs", "related")]
    sources.append(view(spark, sf_dir, "instruments").select(F.col("id").alias("instrument_id"), (F.col("id") % 7).alias("doc_id")))
    return book.by_priority(sources, ["doc_id"], ["instrument_id"], F.col("doc_id"), 2).select("instrument_id", "doc_id", "priority")


@query("select id, cusip from instruments where cusip >= '000000500' order by cusip limit 100")
def keyset_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "instruments").where("cusip >= '000000500'").orderBy("cusip").limit(100).select("id", "cusip")


@query("select instrument_id, line, value from (select *, row_number() over (partition by instrument_id order by value desc nulls last, line) as nth from collateral) x where nth <= 3")
def top_three_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument_id").orderBy(F.col("value").desc_nulls_last(), "line")
    return view(spark, sf_dir, "collateral").withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("instrument_id", "line", "value")


@query("select 'C' || id as wanted from companies where id % 2 = 0 union all select 'X1'")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "companies").select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("wanted"), "id")
    asked = ids.select("wanted").unionByName(spark.createDataFrame([("X1",)], "wanted string"))
    return asked.join(ids.where("id % 2 = 1").select("wanted"), "wanted", "left_anti")


@query("select instrument_id as id, case when price > 0 and instrument_id % 3 = 0 then price end as price, case when price > 0 and instrument_id % 3 = 0 then ytm_bps end as ytm_bps from quotes")
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = book.gated((F.when(F.col("price") > 0, F.col("price")).isNotNull()) & (F.when(F.col("instrument_id") % 3 == 0, "TRACE") == "TRACE"), "price", "ytm_bps")
    return view(spark, sf_dir, "quotes").select(F.col("instrument_id").alias("id"), seen.alias("x")).select("id", F.col("x.price").alias("price"), F.col("x.ytm_bps").alias("ytm_bps"))


@query("select id from companies where sector = 'BUILDING'")
def in_list_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null in an IN list matches nothing, null sectors included."""
    return view(spark, sf_dir, "companies").where(F.col("sector").isin("BUILDING", None)).select("id")


@query("""
    select o_orderkey as id, cast(case o_orderkey % 4 when 0 then o_orderkey * 100000 when 1 then o_orderkey * 100000000 when 2 then round_even(o_orderkey * 100 + 50, 0) else null end as bigint) as cents from orders""")
def scaled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.format_number(k, 0)).when(k % 4 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(".0"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5"))).otherwise("n/a")
    unit = F.when(k % 4 == 0, 100_000).when(k % 4 == 1, 100_000_000).otherwise(100)
    return table(spark, sf_dir, "orders").select(k.alias("id"), book.scaled_money(text, unit).alias("cents"))


@query("select company_id, cast(case when debt_snapshot is null then null when debt_snapshot = '[]' then 0 else 1 end as int) as n, case company_id % 3 when 0 then true when 1 then false end as flag from snapshots")
def json_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.get_json_object(F.concat(F.lit('{"x": "'), F.when(F.col("company_id") % 3 == 0, "true").when(F.col("company_id") % 3 == 1, "false").otherwise("maybe"), F.lit('"}')), "$.x").try_cast("boolean")
    return view(spark, sf_dir, "snapshots").select("company_id", F.json_array_length("debt_snapshot").alias("n"), flag.alias("flag"))
