"""Queries of the library's expressions: dates, ratios, bond maths, identifiers and names.

The test tables have no such texts, so some are made from keys; the SQL beside each says from the key what
the expression has to read out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import AS_OF, table, view
from ..functions import dates, finance, identifiers, names
from .registry import query


def pick(key: str, *values: object) -> Column:
    """One of the values by key."""
    n = len(values)
    out = F.when(F.col(key) % n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(key) % n == i, v)
    return out


@query("select o_orderkey as id, case when o_orderkey % 8 = 6 then null when o_orderkey % 8 = 7 then make_date(year(cast(o_orderdate as date)), 12, 31) else cast(o_orderdate as date) end as day from orders")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda form: F.date_format(F.to_date("o_orderdate"), form)
    text = pick("o_orderkey", d("yyyy-MM-dd"), d("MM/dd/yyyy"), d("MMMM d, yyyy"), F.concat(F.lit(" "), d("MMM d, yyyy")), d("d MMMM yyyy"), d("yyyyMMdd"), F.lit("soon"), d("yyyy"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.parse_date(text).alias("day"))


@query("""
    with d as (select o_orderkey as id, cast(o_orderdate as date) as day from orders)
    select id, cast(year(day) as int) as fiscal_year, cast(case when id % 4 = 0 then 4 else (month(day) + 2) // 3 end as int) as fiscal_quarter,
           cast(case when month(day) <= 3 then year(day) - 1 else year(day) end as int) as filed_year, cast(case when month(day) <= 3 then 4 when month(day) <= 6 then 1 when month(day) <= 9 then 2 else 3 end as int) as filed_quarter from d""")
def filing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    ended, filed = dates.fiscal_period(day, F.when(F.col("o_orderkey") % 4 == 0, "10-K").otherwise("10-Q")), dates.filing_period(day)
    cols = [ended["fiscal_year"].alias("fiscal_year"), ended["fiscal_quarter"].alias("fiscal_quarter"), filed["fiscal_year"].alias("filed_year"), filed["fiscal_quarter"].alias("filed_quarter")]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[c.cast("int").alias(n) for c, n in zip(cols, ("fiscal_year", "fiscal_quarter", "filed_year", "filed_quarter"), strict=True)])


@query("""
    select id, cast(maturity_date - to_months(cast(12 * case when id % 5 = 1 then id % 30 + 1 when instrument_type in ('revolver', 'convertible_notes') then 5 when instrument_type = 'senior_notes' then 8 else 7 end as int)) as date) as issued
    from instruments where maturity_date is not null""")
def estimated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("id") % 5 == 1, F.concat((F.col("id") % 30 + 1).cast("string"), F.lit("-year notes"))).otherwise(F.col("name"))
    rows = view(spark, sf_dir, "instruments").where("maturity_date is not null")
    return rows.select("id", dates.estimated_issue(F.col("maturity_date"), F.col("instrument_type"), name).alias("issued"))


@query(f"""
    with l as (select instrument_id, max(price_date) as last from prices where price_date < DATE '1998-01-20' group by instrument_id),
         d as (select i.id, cast(case when l.last is null then 999 when l.last > {AS_OF} then 0 else {AS_OF} - l.last end as int) as days from instruments i left join l on l.instrument_id = i.id)
    select id, days, case when days <= 1 then 'fresh' when days <= 7 then 'recent' when days <= 30 then 'stale' else 'very_stale' end as label, cast(case when id % 100 < 50 then 2000 else 1900 end + id % 100 as int) as year from d""")
def price_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = view(spark, sf_dir, "prices").where("price_date < DATE '1998-01-20'").groupBy(F.col("instrument_id").alias("id")).agg(F.max("price_date").alias("last"))
    rows = view(spark, sf_dir, "instruments").select("id").join(last, "id", "left").withColumn("days", dates.staleness_days(F.col("last"), F.expr(AS_OF)))
    return rows.select("id", "days", dates.staleness_label(F.col("days")).alias("label"), dates.two_digit_year((F.col("id") % 100).cast("int")).alias("year"))


@query("select event_id, cast(timezone('America/New_York', timezone('UTC', ts)) as date) as day from events")
def business_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.eastern_date(F.col("ts").cast("timestamp")).alias("day"))


@query("""
    select company_id, fiscal_year, fiscal_quarter, case when total_debt <> 0 and ebitda <> 0 then round_even(cast(total_debt as double) / ebitda, 2) end as leverage,
           case when revenue > 0 and ebitda is not null then round_even(cast(ebitda as double) / revenue * 100, 2) end as margin_pct,
           ebitda - abs(coalesce(case when fiscal_quarter = 2 then null else -cash end, 0)) as free_cash, case when ebitda > 0 then least(cast(total_debt as double) * 20 / ebitda, 999.99) end as capped
    from financials""")
def period_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    capex = F.when(F.col("fiscal_quarter") != 2, -F.col("cash"))
    return view(spark, sf_dir, "financials").select(
        "company_id", "fiscal_year", "fiscal_quarter", finance.safe_ratio(F.col("total_debt"), F.col("ebitda")).alias("leverage"), finance.margin(F.col("ebitda"), F.col("revenue")).alias("margin_pct"),
        finance.free_cash_flow(F.col("ebitda"), capex).alias("free_cash"), F.when(F.col("ebitda") > 0, finance.capped(F.col("total_debt").cast("double") * 20 / F.col("ebitda"))).alias("capped"),
    )


@query("""
    with s as (select company_id, fiscal_year, sum(revenue) as cons, sum(case when fiscal_quarter > company_id % 4 then revenue else 0 end) as grp from financials group by company_id, fiscal_year),
         p as (select company_id, fiscal_year, cast(cons - grp as double) * 100 / cons as pct from s)
    select company_id, fiscal_year, round(pct, 4) as leakage_pct, case when pct > 50 then 'high' when pct > 25 then 'elevated' when pct > 10 then 'moderate' else 'low' end as risk from p""")
def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.sum(F.when(F.col("fiscal_quarter") > F.col("company_id") % 4, F.col("revenue")).otherwise(0))
    sums = view(spark, sf_dir, "financials").groupBy("company_id", "fiscal_year").agg(F.sum("revenue").alias("cons"), inside.alias("grp"))
    x = finance.leakage(F.col("cons"), F.col("grp"))
    return sums.select("company_id", "fiscal_year", F.round(x["leakage_pct"], 4).alias("leakage_pct"), x["risk"].alias("risk"))


@query(f"""
    with b as (select id, outstanding, rate_bps / 10000.0 as c, cast(rate_bps + 80 as double) / 10000 as y, cast(maturity_date - {AS_OF} as double) / 365.25 as t from instruments where maturity_date > {AS_OF} and rate_bps > 0),
    n as (select *, floor(t * 2) + 1 as n from b),
    p as (select *, c * 50 * (1 - pow(1 + y / 2, -n)) / (y / 2) + 100 * pow(1 + y / 2, -n) as p0,
          c * 50 * (1 - pow(1 + (y - 0.0001) / 2, -n)) / ((y - 0.0001) / 2) + 100 * pow(1 + (y - 0.0001) / 2, -n) as lo, c * 50 * (1 - pow(1 + (y + 0.0001) / 2, -n)) / ((y + 0.0001) / 2) + 100 * pow(1 + (y + 0.0001) / 2, -n) as hi from n)
    select id, round((lo - hi) / (0.0002 * p0), 4) as duration, round((lo - hi) / (0.0002 * p0) * p0 / 10000, 6) as dv01,
           case when t <= 0.25 then '3M' when t <= 0.75 then '6M' when t <= 1.5 then '1Y' when t <= 2.5 then '2Y' when t <= 4 then '3Y' when t <= 6 then '5Y' when t <= 8.5 then '7Y' when t <= 15 then '10Y' when t <= 25 then '20Y' else '30Y' end as tenor,
           cast(floor(cast(outstanding * (id % 120) as double) / 100) as bigint) as market_value, cast(trunc((cast(id % 997 as double) / 100 - 4.05) * 100) as int) as spread_bps from p""")
def bond_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").where(f"maturity_date > {AS_OF} and rate_bps > 0")
    c, y, t = F.col("rate_bps") / 10_000, (F.col("rate_bps") + 80) / 10_000, finance.years_between(F.expr(AS_OF), F.col("maturity_date"))
    return debt.select(
        "id", F.round(finance.modified_duration(c, y, t), 4).alias("duration"), F.round(finance.dv01(c, y, t), 6).alias("dv01"), finance.benchmark_tenor(t).alias("tenor"),
        finance.market_value(F.col("outstanding"), F.col("id") % 120).alias("market_value"), finance.spread_bps((F.col("id") % 997).cast("double") / 100, F.lit(4.05)).alias("spread_bps"),
    )


RATED = (("AAA", "AAA", "IG"), ("aa1", "AA+", "IG"), (" Baa3 ", "BBB-", "IG"), ("Ba1", "BB+", "HY-BB"), ("BB-", "BB-", "HY-BB"), ("b2", "B", "HY-B"), ("Caa3", "CCC-", "HY-CCC"), ("Ca", "CC", "HY-CCC"), ("A3", "A-", "IG"), ("junk", "NR", "NR"), ("D", "NR", "NR"))


@query(f"""
    with r(nth, rating, band) as (values {", ".join(f"({i}, '{r}', '{b}')" for i, (_, r, b) in enumerate(RATED))})
    select p_partkey as id, rating, band from part join r on r.nth = p_partkey % {len(RATED)}""")
def rating_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), finance.normal_rating(pick("p_partkey", *[raw for raw, _, _ in RATED])).alias("rating"))
    return rows.select("id", "rating", finance.rating_bucket(F.col("rating")).alias("band"))


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"


@query(f"""
    with b as (select id, chr(65 + cast(id % 26 as int)) || substr(cusip, 3, 6) || chr(75 + cast(id % 7 as int)) as base from instruments),
    v as (select *, list_transform(string_split(base, ''), lambda c, i: (strpos('{ALPHABET}', c) - 1) * case when i % 2 = 0 then 2 else 1 end) as x from b),
    c as (select id, base || cast((10 - list_sum(list_transform(x, lambda v: v // 10 + v % 10)) % 10) % 10 as int) as cusip from v),
    d as (select *, string_split(reverse(array_to_string(list_transform(string_split('US' || cusip, ''), lambda c: cast(strpos('{ALPHABET}', c) - 1 as varchar)), '')), '') as y from c),
    s as (select id, cusip, list_sum(list_transform(y, lambda c, i: case when i % 2 = 1 then (cast(c as int) * 2) // 10 + (cast(c as int) * 2) % 10 else cast(c as int) end)) as total from d),
    i as (select id, cusip, 'US' || cusip || cast((10 - total % 10) % 10 as int) as isin from s)
    select id, cusip, isin, cusip as back, substr(cusip, 1, 6) as issuer, true as good, false as bad from i""")
def isin_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id").cast("int")
    base = F.concat(F.char(65 + key % 26), F.substring("cusip", 3, 6), F.char(75 + key % 7))
    rows = view(spark, sf_dir, "instruments").select("id", identifiers.normal_cusip(F.lower(base)).alias("cusip"))
    rows = rows.withColumn("isin", identifiers.cusip_to_isin(F.col("cusip")))
    spoilt = F.concat(F.substring("isin", 1, 11), ((F.substring("isin", 12, 1).cast("int") + 1) % 10).cast("string"))
    return rows.select("id", "cusip", "isin", identifiers.isin_to_cusip(F.concat(F.lit(" "), "isin")).alias("back"), identifiers.issuer_code(F.col("cusip")).alias("issuer"), identifiers.is_isin(F.col("isin")).alias("good"), identifiers.is_isin(spoilt).alias("bad"))


@query("""
    with n as (select p_partkey as id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as name from part)
    select id, name || case id % 6 when 0 then ' corp' when 1 then ' inc' when 2 then ' llc' when 3 then ' co' when 4 then ' ltd' else '' end as normal, name as bare from n""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("name", F.regexp_replace("p_name", "[^A-Za-z0-9 ]", " "))
    whole = F.concat(F.when(F.col("p_partkey") % 4 == 0, "The ").otherwise(""), F.regexp_replace("name", " ", "  "), pick("p_partkey", " Corporation", ", Inc.", " L.L.C", " Company", " LIMITED", "  "))
    bare = F.concat("name", pick("p_partkey", ", Corp.", " Inc", " LLC", " Co.", " Limited", ""))
    return parts.select(F.col("p_partkey").alias("id"), names.normal_name(whole).alias("normal"), names.bare_name(bare).alias("bare"))


@query("""
    select p_partkey as id, cast(case p_partkey % 5 when 0 then 525 when 1 then 537 + 0.5 when 2 then null when 3 then null else 600 end as int) as bps, cast(case p_partkey % 5 when 0 then 2020 + p_partkey % 80 when 1 then 2030 when 2 then 2027 when 3 then null else 2035 end as int) as year,
           case p_partkey % 5 when 0 then 'senior_secured_notes' when 1 then 'convertible_notes' when 2 then 'term_loan_b' when 3 then 'revolver' else 'subordinated_notes' end as kind from part""")
def note_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (2020 + F.col("p_partkey") % 80).cast("string")
    name = pick("p_partkey", F.concat(F.lit("5.25% Senior Secured Notes due "), year), "5 3/8% Convertible Notes 2030", "Term Loan B of June 2027", "Revolving Credit Facility", "6% Subordinated Debentures, maturing 2035")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.coupon_bps(name).alias("bps"), names.maturity_year(name).alias("year"), names.instrument_type(name).alias("kind"))


@query("""
    with e as (select event_id, event_id * 37 % 9000 as ms from events)
    select event_id, case event_id % 4 when 0 then '/v1/companies/{ticker}/debt' when 1 then '/v1/bonds/{id}' when 2 then '/v1/pages/{n}/rows/{n}' else '/v1/search' end as path,
           case when ms < 100 then '<100ms' when ms < 500 then '100-500ms' when ms < 1000 then '500ms-1s' when ms < 5000 then '1-5s' else '>5s' end as bucket from e""")
def request_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pick("event_id", "/v1/companies/BRK.B/debt", "/v1/bonds/0a1b2c3d-0000-4a4a-8b8b-0123456789ab", F.concat(F.lit("/v1/pages/"), F.col("event_id").cast("string"), F.lit("/rows/7")), "/v1/search")
    return table(spark, sf_dir, "events").select("event_id", names.normal_path(path).alias("path"), names.latency_bucket(F.col("event_id") * 37 % 9000).alias("bucket"))
