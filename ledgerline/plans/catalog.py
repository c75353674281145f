"""The named queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import AS_OF, both, duck, table, view
from ..durable import run_dir
from ..functions import finance, identifiers, names
from ..operators import aggregates as ag
from ..operators import extraction, graph, joins, matching, text, upsert
from ..operators.screen import Screen, percent_to_bps
from ..sources import readers
from ..streaming import counters
from . import api, quality
from .registry import ORACLE, QUERIES, query, same_sql

# ---- screens -------------------------------------------------------------------------------------


@query("""
    select i.id, i.cusip, c.ticker, c.sector, i.seniority, i.rate_bps, i.outstanding, i.maturity_date, cast(coalesce(g.n, 0) as bigint) as n_guarantors
    from instruments i join companies c on i.company_id = c.id
    left join (select instrument_id, count(*) as n from guarantees group by instrument_id) g on g.instrument_id = i.id
    where c.sector in ('AUTOMOBILE', 'BUILDING') and i.seniority in ('1-URGENT', '2-HIGH') and i.outstanding >= 5000000 and i.rate_bps >= 434 and i.is_active
    order by i.outstanding desc nulls last, i.id limit 50""")
def bond_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt, companies = view(spark, sf_dir, "instruments"), view(spark, sf_dir, "companies").select(F.col("id").alias("company_id"), "ticker", "sector")
    screen = (
        Screen(debt.join(companies, "company_id"), ("id",))
        .is_in("sector", ["AUTOMOBILE", "BUILDING"]).is_in("seniority", ["1-URGENT", "2-HIGH"])
        .between("outstanding", 5_000_000).between("rate_bps", percent_to_bps(4.35)).equals(is_active=True)
        .sort("-outstanding")
    )
    page = screen.page(50)
    guarantors = view(spark, sf_dir, "guarantees").groupBy(F.col("instrument_id").alias("id")).agg(F.count(F.lit(1)).alias("n_guarantors"))
    out = page.join(guarantors, "id", "left").withColumn("n_guarantors", F.coalesce("n_guarantors", F.lit(0)))
    return out.select("id", "cusip", "ticker", "sector", "seniority", "rate_bps", "outstanding", "maturity_date", "n_guarantors")


@query("""
    select c.id, c.ticker, c.sector, d.total_debt, cast(coalesce(d.n_bonds, 0) as bigint) as n_bonds from companies c
    left join (select company_id, cast(sum(outstanding) as bigint) as total_debt, count(*) as n_bonds from instruments group by company_id) d on d.company_id = c.id
    where c.sector ilike '%mach%' and (d.total_debt <= 200000000 or d.total_debt is null)
    order by d.total_debt desc nulls last, c.id limit 100 offset 20""")
def company_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").groupBy(F.col("company_id").alias("id")).agg(F.sum("outstanding").alias("total_debt"), F.count(F.lit(1)).alias("n_bonds"))
    joined = view(spark, sf_dir, "companies").join(debt, "id", "left").withColumn("n_bonds", F.coalesce("n_bonds", F.lit(0)))
    screen = Screen(joined, ("id",)).contains("sector", "mach").where((F.col("total_debt") <= 200_000_000) | F.col("total_debt").isNull())
    return screen.fields("id,ticker,sector,total_debt,n_bonds").sort("-total_debt").page(100, 20)


@query("""
    select id, cusip, instrument_type, rate_bps, maturity_date from instruments
    where rate_bps between 500 and 600 and maturity_date between DATE '2000-01-01' and DATE '2000-12-31' and outstanding is not null
      and id in (select instrument_id from guarantees) order by maturity_date nulls last, id limit 100""")
def bond_search_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = Screen(view(spark, sf_dir, "instruments"), ("id",)).near("rate_bps", 550, 50).in_year("maturity_date", 2000).present("outstanding", True)
    screen = screen.having(view(spark, sf_dir, "guarantees"), "id", "instrument_id", True)
    return screen.sort("maturity_date").fields("id,cusip,instrument_type,rate_bps,maturity_date").page(100)


@query("""
    select c.instrument_id, c.line, c.collateral_type, c.priority, c.value, i.seniority from collateral c join instruments i on i.id = c.instrument_id
    where c.value >= 9000000 and i.seniority = '1-URGENT' order by c.value desc nulls last, c.instrument_id, c.line limit 200""")
def collateral_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").select(F.col("id").alias("instrument_id"), "seniority")
    screen = Screen(view(spark, sf_dir, "collateral").join(debt, "instrument_id"), ("instrument_id", "line")).between("value", 9_000_000).equals(seniority="1-URGENT")
    return screen.sort("-value").fields("instrument_id,line,collateral_type,priority,value,seniority").page(200, most=200)


@query("""
    select v.id, v.covenant_type, v.test_metric, v.threshold, i.instrument_type from covenants v left join instruments i on i.id = v.instrument_id
    where v.test_metric = 'leverage_ratio' and v.threshold <= 3 order by v.threshold nulls last, v.id limit 200""")
def covenant_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").select(F.col("id").alias("instrument_id"), "instrument_type")
    screen = Screen(view(spark, sf_dir, "covenants").join(debt, "instrument_id", "left"), ("id",)).equals(test_metric="leverage_ratio").between("threshold", None, 3)
    return screen.sort("threshold").fields("id,covenant_type,test_metric,threshold,instrument_type").page(200, most=200)


# ---- joins ---------------------------------------------------------------------------------------


@query("select id, company_id from instruments i where exists (select 1 from guarantees g where g.instrument_id = i.id)")
def semi_join_has_guarantor(spark: SparkSession, sf_dir: str) -> DataFrame:
    guarantees = view(spark, sf_dir, "guarantees").withColumnRenamed("instrument_id", "id")
    return joins.semi(view(spark, sf_dir, "instruments"), guarantees, ["id"]).select("id", "company_id")


@query("select id, name from entities e where not exists (select 1 from guarantees g where g.guarantor_id = e.company_id)")
def anti_join_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = view(spark, sf_dir, "guarantees").select(F.col("guarantor_id").alias("company_id"))
    return joins.anti(view(spark, sf_dir, "entities"), linked, ["company_id"]).select("id", "name")


# The `_whole` queries say the same as those they are named after, whose earlier forms took a part of their views.


@query("select id, company_id from instruments i where exists (select 1 from guarantees g where g.instrument_id = i.id)")
def semi_join_has_guarantor_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    guarantees = view(spark, sf_dir, "guarantees").withColumnRenamed("instrument_id", "id")
    return joins.semi(view(spark, sf_dir, "instruments"), guarantees, ["id"]).select("id", "company_id")


@query("select id, name from entities e where not exists (select 1 from guarantees g where g.guarantor_id = e.company_id)")
def anti_join_unlinked_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = view(spark, sf_dir, "guarantees").select(F.col("guarantor_id").alias("company_id"))
    return joins.anti(view(spark, sf_dir, "entities"), linked, ["company_id"]).select("id", "name")


@query("""
    select f.company_id, f.fiscal_year, f.fiscal_quarter, f.revenue from financials f
    join (select company_id, max(fiscal_year) as fiscal_year from financials group by company_id) l on l.company_id = f.company_id and l.fiscal_year = f.fiscal_year""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_ties(view(spark, sf_dir, "financials"), ["company_id"], "fiscal_year").select("company_id", "fiscal_year", "fiscal_quarter", "revenue")


@query("select distinct on (instrument_id) instrument_id, price_date, price_cents from prices order by instrument_id, price_date desc")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_one(view(spark, sf_dir, "prices").select("instrument_id", "price_date", "price_cents"), ["instrument_id"], ["price_date"])


@query("select c.id, t.bond_id, t.outstanding from companies c join lateral (select i.id as bond_id, i.outstanding from instruments i where i.company_id = c.id and i.outstanding is not null order by i.outstanding desc, i.id limit 1) t on true")
def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Said in DataFrames: Spark turns the lateral LIMIT into a row number without the ORDER BY, whose rows a shuffle hands on in any order."""
    debt = view(spark, sf_dir, "instruments").where("outstanding is not null")
    first = F.struct("outstanding", F.bitwise_not("id"))  # the smaller id first
    best = debt.groupBy(F.col("company_id").alias("id")).agg(F.max_by(F.struct(F.col("id").alias("bond_id"), "outstanding"), first).alias("t"))
    return view(spark, sf_dir, "companies").select("id").join(best, "id").select("id", "t.bond_id", "t.outstanding")


same_sql(
    "scalar_subqueries",
    "select c.id, (select count(*) from instruments i where i.company_id = c.id) as n_bonds, (select max(i.maturity_date) from instruments i where i.company_id = c.id) as last_maturity from companies c",
)


@query("""
    select p.instrument_id, p.price_date, t.yield_date, t.yield_bps from prices p
    asof left join (select yield_date - 9500 as yield_date, yield_bps from treasuries where benchmark = 'view') t on p.price_date >= t.yield_date""")
def asof_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_curve(spark, sf_dir, view(spark, sf_dir, "prices"))


@query("""
    select p.instrument_id, p.price_date, t.yield_date, t.yield_bps from prices p
    asof left join (select yield_date - 9500 as yield_date, yield_bps from treasuries where benchmark = 'view') t on p.price_date >= t.yield_date""")
def asof_curve_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_curve(spark, sf_dir, view(spark, sf_dir, "prices"))


def on_curve(spark: SparkSession, sf_dir: str, prices: DataFrame) -> DataFrame:
    """Prices with the last curve value at or before their day."""
    prices = prices.select("instrument_id", "price_date", F.lit("view").alias("benchmark"))
    curve = view(spark, sf_dir, "treasuries").select("benchmark", F.date_sub("yield_date", 9500).alias("yield_date"), "yield_bps")
    # one curve for all prices: bucket by year so that the running window is not one partition
    bucketed = lambda df, c: df.withColumn("bucket", F.year(c))
    last = joins.latest_one(bucketed(curve, "yield_date").select("benchmark", "bucket", "yield_date", "yield_bps"), ["benchmark", "bucket"], ["yield_date"])
    later = last.select("benchmark", F.explode(F.sequence(F.col("bucket") + 1, F.col("bucket") + 60)).alias("bucket"), "yield_date", "yield_bps")
    carried = joins.latest_one(later, ["benchmark", "bucket"], ["yield_date"])
    values = carried.select("benchmark", "bucket", F.make_date("bucket", F.lit(1), F.lit(1)).alias("at"), F.struct("yield_date", "yield_bps").alias("y"))
    values = values.unionByName(bucketed(curve, "yield_date").select("benchmark", "bucket", F.col("yield_date").alias("at"), F.struct("yield_date", "yield_bps").alias("y")))
    days = bucketed(prices, "price_date").select("benchmark", "bucket", "price_date").distinct()
    found = joins.as_of(days, values, ["benchmark", "bucket"], "price_date", "at", ["y"])
    return prices.join(found.select("price_date", "y"), "price_date", "left").select("instrument_id", "price_date", "y.yield_date", "y.yield_bps")


@query("""
    select a.id, b.id as id_other, a.company_id from instruments a join instruments b on a.company_id = b.company_id
    where a.id < b.id and abs(a.rate_bps - b.rate_bps) <= 5""")
def band_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").select("id", "company_id", "rate_bps")
    return joins.band(debt, debt, ["company_id"], "rate_bps", 5).where("id < id_other").select("id", "id_other", "company_id")


@query("select e.id, e.parent_id from entities e where e.id in (select id from entities where entity_type = 'finco') or e.parent_id in (select id from entities where entity_type = 'finco')")
def or_join_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = view(spark, sf_dir, "entities")
    return joins.semi_any(entities.select("id", "parent_id"), entities.where("entity_type = 'finco'").select(F.col("id").alias("k")), "k", ["id", "parent_id"])


@query("""
    with b as (select distinct company_id, instrument_type from instruments where issue_date < DATE '1997-01-01'),
         a as (select distinct company_id, instrument_type from instruments where issue_date >= DATE '1997-01-01')
    select coalesce(a.company_id, b.company_id) as company_id, coalesce(a.instrument_type, b.instrument_type) as instrument_type,
           case when b.company_id is null then 'added' when a.company_id is null then 'removed' else 'kept' end as status
    from a full outer join b on a.company_id = b.company_id and a.instrument_type = b.instrument_type""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments")
    cut = F.lit("1997-01-01").cast("date")
    return joins.changes(debt.where(F.col("issue_date") < cut), debt.where(F.col("issue_date") >= cut), ["company_id", "instrument_type"])


@query("""
    with b as (select distinct company_id, instrument_type from instruments where issue_date < DATE '1997-01-01'),
         a as (select distinct company_id, instrument_type from instruments where issue_date >= DATE '1997-01-01')
    select coalesce(a.company_id, b.company_id) as company_id, coalesce(a.instrument_type, b.instrument_type) as instrument_type,
           case when b.company_id is null then 'added' when a.company_id is null then 'removed' else 'kept' end as status
    from a full outer join b on a.company_id = b.company_id and a.instrument_type = b.instrument_type""")
def snapshot_diff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt, cut = view(spark, sf_dir, "instruments"), F.lit("1997-01-01").cast("date")
    return joins.changes(debt.where(F.col("issue_date") < cut), debt.where(F.col("issue_date") >= cut), ["company_id", "instrument_type"])


# ---- aggregates ----------------------------------------------------------------------------------


@query("""
    select c.sector, cast(count(*) as bigint) as n, cast(sum(i.outstanding) as bigint) as debt, cast(sum(i.principal) as bigint) as principal, round(avg(i.rate_bps), 4) as avg_rate
    from companies c join instruments i on i.company_id = c.id where c.sector is not null group by c.sector""")
def sector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = view(spark, sf_dir, "companies").where("sector is not null").select(F.col("id").alias("company_id"), "sector")
    rows = companies.join(view(spark, sf_dir, "instruments"), "company_id")
    return rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum("outstanding").alias("debt"), F.sum("principal").alias("principal"), F.round(F.avg("rate_bps"), 4).alias("avg_rate"))


@query("""
    select company_id, list_sort(list(outstanding) filter (where outstanding is not null))[cast(floor(count(outstanding) / 2) as bigint) + 1] as median_debt, cast(count(*) filter (where rate_bps > 600) as bigint) as n_high
    from instruments group by company_id""")
def sector_detail_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments")
    return debt.groupBy("company_id").agg(ag.upper_median(F.col("outstanding")).alias("median_debt"), F.count_if(F.col("rate_bps") > 600).alias("n_high"))


@query("""
    select company_id, round(cast(sum(case when rate_bps <> 0 and outstanding <> 0 then cast(rate_bps as double) * outstanding end) as double) / sum(case when rate_bps <> 0 and outstanding <> 0 then outstanding end), 4) as avg_rate
    from instruments group by company_id""")
def weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = ag.weighted_average(F.col("rate_bps").cast("double"), F.col("outstanding").cast("double"))
    return view(spark, sf_dir, "instruments").groupBy("company_id").agg(F.round(value, 4).alias("avg_rate"))


@query(f"""
    with r as (select *, row_number() over (partition by company_id order by fiscal_year desc, fiscal_quarter desc) as nth from financials where period_end < {AS_OF})
    select company_id, cast(sum(revenue) as bigint) as revenue, cast(sum(ebitda) as bigint) as ebitda, cast(count(*) as bigint) as quarters,
           cast(max(case when nth = 1 then cash end) as bigint) as cash from r where nth <= 4 group by company_id""")
def ttm_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "financials").where(f"period_end < {AS_OF}")
    last = ag.latest_n(rows, ["company_id"], [F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc()], 4)
    return last.groupBy("company_id").agg(F.sum("revenue").alias("revenue"), F.sum("ebitda").alias("ebitda"), F.count(F.lit(1)).alias("quarters"), F.max(F.when(F.col("nth") == 1, F.col("cash"))).alias("cash"))


@query(f"""
    with d as (select company_id, outstanding, cast(maturity_date - {AS_OF} as bigint) as days from instruments where maturity_date is not null)
    select company_id, cast(coalesce(sum(case when days <= 365 then outstanding end), 0) as bigint) as due_1y, cast(coalesce(sum(case when days > 365 and days <= 730 then outstanding end), 0) as bigint) as due_2y,
           cast(coalesce(sum(case when days > 730 and days <= 1095 then outstanding end), 0) as bigint) as due_3y, cast(count(*) filter (where days > 1095) as bigint) as later from d group by company_id""")
def maturity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("maturity_date", F.expr(AS_OF))
    bucket = ag.buckets(days, (365, 730, 1095), ("due_1y", "due_2y", "due_3y", "later"))
    rows = view(spark, sf_dir, "instruments").where("maturity_date is not null").withColumn("bucket", bucket)
    part = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("outstanding"))), F.lit(0)).alias(b)
    return rows.groupBy("company_id").agg(part("due_1y"), part("due_2y"), part("due_3y"), F.count_if(F.col("bucket") == "later").alias("later"))


@query("""
    select company_id, array_to_string(list_transform(list_sort(list({'s': -coalesce(outstanding, 0), 'i': id})), lambda x: cast(x.i as varchar)), ',') as ids
    from instruments group by company_id""")
def ordered_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ag.ordered_ids(F.col("id"), -F.coalesce("outstanding", F.lit(0)))
    return view(spark, sf_dir, "instruments").groupBy("company_id").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


same_sql(
    "two_level_agg",
    "select company_id, cast(count(*) as bigint) as n_groups, cast(sum(total - most) as bigint) as removable from (select company_id, seniority, sum(outstanding) as total, max(outstanding) as most from instruments where outstanding is not null group by company_id, seniority having count(*) > 1) g group by company_id",
)
same_sql("filter_agg", "select seniority, cast(count(*) as bigint) as n, cast(count(*) filter (where is_active) as bigint) as n_active, cast(sum(case when rate_type = 'floating' then outstanding end) as bigint) as floating from instruments group by seniority")
same_sql("having_ratio", "select company_id, cast(count(*) as bigint) as n, cast(count(outstanding) as bigint) as with_amount from instruments group by company_id having count(outstanding) * 100 < 90 * count(*)")
same_sql("pre_aggregate_join", "select c.id, d.debt, f.revenue from companies c left join (select company_id, cast(sum(outstanding) as bigint) as debt from instruments group by company_id) d on d.company_id = c.id left join (select company_id, cast(sum(revenue) as bigint) as revenue from financials group by company_id) f on f.company_id = c.id")
same_sql("distinct_multi_column_in", "select distinct company_id, seniority from instruments where (company_id, seniority) in (select company_id, seniority from instruments where rate_type = 'floating' and is_active)")
same_sql("union_all_tagged", "select id, 'outstanding' as field, outstanding as amount from instruments where outstanding > 40000000 union all select id, 'principal', principal from instruments where principal > 45000000 union all select company_id, 'revenue', revenue from financials where revenue > 30000000")
same_sql("set_operations", "(select company_id from instruments where seniority = '1-URGENT' intersect select company_id from instruments where seniority = '5-LOW') except select company_id from covenants where threshold = 50")
same_sql("rollup_cube_extra", "select seniority, instrument_type, cast(count(*) as bigint) as n from instruments group by rollup (seniority, instrument_type)")
same_sql("group_by_expression", "select cast(floor(rate_bps / 100.0) as bigint) as rate_pct, cast(year(maturity_date) as bigint) as maturity_year, cast(count(*) as bigint) as n from instruments where maturity_date is not null group by floor(rate_bps / 100.0), year(maturity_date)")
same_sql("window_ranks_extra", "select id, company_id, cast(rank() over (partition by company_id order by outstanding desc nulls last) as bigint) as rnk, cast(ntile(4) over (partition by company_id order by id) as bigint) as quartile, cast(sum(outstanding) over (partition by company_id order by id rows between 2 preceding and current row) as bigint) as running from instruments")


@query("""
    select company_id, bool_or(covenant_type = 'financial') as financial, bool_or(covenant_type = 'negative') as negative, bool_or(covenant_type = 'incurrence') as incurrence from covenants group by company_id""")
def pivot_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.pivot_flags(view(spark, sf_dir, "covenants"), "company_id", "covenant_type", ["financial", "negative", "incurrence"])


@query("select id, company_id from (select *, row_number() over (partition by company_id, covenant_type, test_metric, threshold order by created, id) as rn from covenants) x where rn > 1")
def dedupe_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("company_id", "covenant_type", "test_metric", "threshold").orderBy("created", "id")
    return view(spark, sf_dir, "covenants").withColumn("rn", F.row_number().over(w)).where("rn > 1").select("id", "company_id")


@query("""
    with l as (select instrument_id, price_date, price_cents, lag(price_cents) over w as before, lag(price_date) over w as day_before from prices window w as (partition by instrument_id order by price_date))
    select instrument_id, price_date, price_cents, before from l where before > 0 and abs(price_cents - before) > 0.01 * before and price_date - day_before <= 60""")
def price_jump_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.jumps(view(spark, sf_dir, "prices"), "instrument_id", "price_date", "price_cents", 0.01, 60).select("instrument_id", "price_date", "price_cents", "before")


@query("select instrument_id, price_date, cast(price_date - before as bigint) as gap from (select instrument_id, price_date, lag(price_date) over (partition by instrument_id order by price_date) as before from prices) x where price_date - before > 300")
def history_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument_id").orderBy("price_date")
    return view(spark, sf_dir, "prices").withColumn("gap", F.datediff("price_date", F.lag("price_date").over(w)).cast("long")).where("gap > 300").select("instrument_id", "price_date", "gap")


@query("""
    select cast(created_at as date) as day, cast(count(*) as bigint) as n, cast(sum(cost_cents) as bigint) as cost, cast(count(distinct endpoint) as bigint) as n_endpoints, cast(count(distinct user_id) as bigint) as n_users
    from usage_log group by cast(created_at as date)""")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "usage_log").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_cents").alias("cost"), F.countDistinct("endpoint").alias("n_endpoints"), F.countDistinct("user_id").alias("n_users"))


@query("""
    with b as (select max(day) as last from usage_log), s as (
      select endpoint, count(*) filter (where day > last - 7) as now, count(*) filter (where day > last - 14 and day <= last - 7) as before from usage_log, b group by endpoint)
    select endpoint, cast(now as bigint) as n_now, cast(before as bigint) as n_before,
           round(case when before = 0 then case when now > 0 then 100.0 else 0.0 end else (now - before) * 100.0 / before end, 4) as change_pct,
           case when before = 0 and now > 0 then 'increasing' when before > 0 and (now - before) * 100.0 / before > 10 then 'increasing' when before > 0 and (now - before) * 100.0 / before < -10 then 'decreasing' else 'stable' end as trend from s""")
def usage_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "usage_log").select("endpoint", "day")
    last = log.agg(F.max("day").alias("last"))
    rows = log.crossJoin(F.broadcast(last)).withColumn("age", F.datediff("last", "day"))  # one row on the right
    sums = rows.groupBy("endpoint").agg(F.count_if(F.col("age") < 7).alias("n_now"), F.count_if((F.col("age") >= 7) & (F.col("age") < 14)).alias("n_before"))
    change = ag.period_change(F.col("n_now"), F.col("n_before")).cast("double")
    return sums.select("endpoint", "n_now", "n_before", F.round(change, 4).alias("change_pct"), ag.trend(change).alias("trend"))


same_sql("frequency_top10", "select country, cast(count(*) as bigint) as n from companies group by country order by n desc, country limit 10")
same_sql("json_extract", "select user_id, cast(sum(cast(get_json_object(props, '$.k') as bigint)) as bigint) as k, cast(count(get_json_object(props, '$.none')) as bigint) as absent from usage_log group by user_id", "select user_id, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k, cast(count(json_extract_string(props, '$.none')) as bigint) as absent from usage_log group by user_id")
same_sql("latency_histogram", "select case when latency_ms < 10 then '<10' when latency_ms < 50 then '10-50' else '50+' end as bucket, cast(count(*) as bigint) as n, cast(min(latency_ms) as bigint) as least from usage_log group by case when latency_ms < 10 then '<10' when latency_ms < 50 then '10-50' else '50+' end")
same_sql("hourly_errors", "select day, cast(hour(created_at) as bigint) as hour, cast(count(*) as bigint) as n, cast(count(*) filter (where status >= 500) as bigint) as n_5xx, cast(count(*) filter (where status >= 400 and status < 500) as bigint) as n_4xx from usage_log group by day, hour(created_at)")


# ---- graph ---------------------------------------------------------------------------------------


@query("""
    with recursive t as (select id, 0 as depth from entities where id = 'R1' union all select e.id, t.depth + 1 from entities e join t on e.parent_id = t.id where t.depth < 4 and e.entity_type <> 'none')
    select id, cast(min(depth) as int) as depth from t where depth > 0 group by id""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = view(spark, sf_dir, "entities")
    return graph.descendants(entities, entities.where("id = 'R1'").select("id"), 4, F.col("entity_type") != "none")


@query("""
    select a.id as id, 1 as depth from entities s join entities a on a.id = s.parent_id where s.id = 'S7' union all
    select b.id, 2 from entities s join entities a on a.id = s.parent_id join entities b on b.id = a.parent_id where s.id = 'S7' union all
    select c.id, 3 from entities s join entities a on a.id = s.parent_id join entities b on b.id = a.parent_id join entities c on c.id = b.parent_id where s.id = 'S7'""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = view(spark, sf_dir, "entities")
    return graph.ancestors(entities, entities.where("id = 'S7'").select("id"), 5)


@query("""
    with v as (select concat('C', company_id) as id, sum(outstanding) as value from instruments group by company_id),
         up as (select id, id as anc from entities union all select e.id, e.parent_id from entities e where e.parent_id is not null
                union all select e.id, p.parent_id from entities e join entities p on p.id = e.parent_id where p.parent_id is not null
                union all select e.id, q.parent_id from entities e join entities p on p.id = e.parent_id join entities q on q.id = p.parent_id where q.parent_id is not null)
    select anc as id, cast(coalesce(sum(v.value), 0) as bigint) as total, cast(count(*) as bigint) as members from up left join v on v.id = up.id group by anc""")
def subtree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").select(F.concat(F.lit("C"), "company_id").alias("id"), F.col("outstanding").alias("value"))
    return graph.subtree_sums(view(spark, sf_dir, "entities").select("id", "parent_id"), debt, 3)


same_sql("ownership_edges", "select p.id as parent_id, c.id as child_id, p.entity_type as parent_type, cast(count(*) over (partition by p.id) as bigint) as n_children from entities c join entities p on p.id = c.parent_id")


# ---- scalars -------------------------------------------------------------------------------------


@query("""
    with c as (select id, left(cusip, 8) as base from instruments), d as (
      select id, base, list_sum(list_transform(range(1, 9), lambda i: case when i % 2 = 0 then (cast(base[i] as int) * 2) // 10 + (cast(base[i] as int) * 2) % 10 else cast(base[i] as int) end)) as s from c)
    select id, concat(base, cast((10 - s % 10) % 10 as int)) as cusip9 from d""")
def cusip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "instruments").select("id", identifiers.normal_cusip(F.substring("cusip", 1, 8)).alias("cusip9"))


@query("select p_partkey as id, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') as slug, upper(p_brand) as brand from part")
def name_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.slug(F.col("p_name")).alias("slug"), F.upper("p_brand").alias("brand"))


@query(f"""
    with b as (select id, rate_bps / 10000.0 as c, cast(rate_bps + 50 as double) / 10000 as y, floor(cast(maturity_date - {AS_OF} as double) / 365.25 * 2) + 1 as n from instruments where maturity_date > {AS_OF} and rate_bps > 0)
    select id, round(c * 50 * (1 - pow(1 + y / 2, -n)) / (y / 2) + 100 * pow(1 + y / 2, -n), 6) as price from b""")
def price_from_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").where(f"maturity_date > {AS_OF} and rate_bps > 0")
    years = finance.years_between(F.expr(AS_OF), F.col("maturity_date"))
    return debt.select("id", F.round(finance.price_from_yield(F.col("rate_bps") / 10_000, (F.col("rate_bps") + 50) / 10_000, years), 6).alias("price"))


@query(f"select id, round((rate_bps + 50) / 10000.0, 6) as ytm from instruments where maturity_date > {AS_OF} and rate_bps > 0")
def yield_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yield of each bond's own price gives back the yield it was priced at."""
    debt = view(spark, sf_dir, "instruments").where(f"maturity_date > {AS_OF} and rate_bps > 0")
    years = finance.years_between(F.expr(AS_OF), F.col("maturity_date"))
    priced = debt.select("id", (F.col("rate_bps") / 10_000).alias("c"), years.alias("t"), finance.price_from_yield(F.col("rate_bps") / 10_000, (F.col("rate_bps") + 50) / 10_000, years).alias("p"))
    return priced.select("id", F.round(finance.yield_to_maturity("p", "c", "t"), 6).alias("ytm"))


@query("""
    with curve(rating, tenor, spread) as (values ('IG', 1, 40), ('IG', 5, 120), ('IG', 10, 180), ('HY', 1, 250), ('HY', 5, 400), ('HY', 10, 520)),
    b as (select id, case when rate_bps < 600 then 'IG' else 'HY' end as rating, cast(id % 13 as double) as years from instruments),
    s as (select *, lead(tenor) over w as hi, lead(spread) over w as hi_spread, row_number() over w as nth from curve window w as (partition by rating order by tenor))
    select id, rating, years, cast(floor(case when hi is null then spread else spread + (hi_spread - spread) * (greatest(years, tenor) - tenor) / cast(hi - tenor as double) end) as int) as spread_bps
    from b join s using (rating) where (years >= tenor or nth = 1) and (years < hi or hi is null)""")
def spread_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = spark.createDataFrame([("IG", 1, 40), ("IG", 5, 120), ("IG", 10, 180), ("HY", 1, 250), ("HY", 5, 400), ("HY", 10, 520)], "rating string, tenor int, spread int")
    bonds = view(spark, sf_dir, "instruments").select("id", F.when(F.col("rate_bps") < 600, "IG").otherwise("HY").alias("rating"), (F.col("id") % 13).cast("double").alias("years"))
    return finance.interpolated_spread(bonds, curve).select("id", "rating", "years", "spread_bps")


#: clean_html in SQL: the head, then scripts and styles outside it, each by itself.
CLEANED = r"""
    c1 as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g') as t from pages),
    c2 as (select page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') as t from c1),
    c3 as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as t from c2),
    cleaned as (select page_id, trim(regexp_replace(regexp_replace(t, '[ \t\x{00A0}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), concat(' ', chr(10))) as t from c3)"""


@query(f"with {CLEANED} select page_id, cast(length(t) as bigint) as n_chars, cast(len(string_split(t, chr(10))) as bigint) as n_lines from cleaned")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = names.clean_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(cleaned).cast("long").alias("n_chars"), F.size(F.split(cleaned, "\n")).cast("long").alias("n_lines"))


# ---- text and vectors ----------------------------------------------------------------------------


@query("""
    with words as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'will', 'with')) as ws from documents),
    hits as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as nth from words),
    terms as (select doc_id, case when w in ('license', 'licenses', 'licensed', 'licensing', 'licens') then 'licens' when w in ('version', 'versions', 'versioned', 'versioning') then 'version' end as term, nth from hits),
    per as (select doc_id, term, count(*) as tf, min(nth) as first from terms where term is not null group by doc_id, term)
    select doc_id, round(sum(ln(1 + tf)) / (1 + ln(1 + max(first) - min(first))), 4) as score from per group by doc_id having count(*) = 2 order by score desc, doc_id limit 100""")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_texts(table(spark, sf_dir, "documents"), "the license of version").orderBy(F.col("score").desc(), "doc_id").limit(100)


@query("""
    select doc_id, cast(len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(\\d{1,2}\\.\\d{1,4})\\s*%', 1), lambda x: cast(x as double)), lambda x: x > 0 and x < 25))) as bigint) as n_coupons,
           cast(len(list_distinct(regexp_extract_all(text, '\\b(20\\d\\d)\\b', 1))) as bigint) as n_years from documents""")
def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(20\d\d)\b"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.coupons(F.col("text"))).cast("long").alias("n_coupons"), F.size(year).cast("long").alias("n_years"))


@query("""
    with q as (select embedding as e from embeddings where vec_id = 0)
    select vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), list_transform(q.e, lambda x: cast(x as double))), 5) as score from embeddings, q order by list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), list_transform(q.e, lambda x: cast(x as double))) desc, vec_id limit 10""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    probe = [float(x) for x in vectors.where("vec_id = 0").first().embedding]
    return text.nearest(vectors, probe, 10).select("vec_id", F.round("score", 5).alias("score"))


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    known = parts.select(F.col("p_name").alias("known_name")).distinct()
    return matching.fuzzy_join(parts, known, "p_name", "known_name", "p_partkey", 0.85).select("p_partkey", "p_name", "known_name", F.round("score", 4).alias("score"))


@query()
def fuzzy_names_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter gone from the front, the middle or nowhere, against the names of the list."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    gone = F.element_at(F.array(F.lit(2), F.lit(6), F.lit(0)), (F.col("p_partkey") % 3 + 1).cast("int"))
    changed = parts.withColumn("changed_name", F.when(gone > 0, F.concat(F.substring("p_name", F.lit(1), gone - 1), F.substring("p_name", gone + 1, F.length("p_name")))).otherwise(F.col("p_name")))
    known = parts.select(F.col("p_name").alias("known_name")).distinct()
    return matching.fuzzy_join(changed, known, "changed_name", "known_name", "p_partkey", 0.85).select("p_partkey", "changed_name", "known_name", F.round("score", 4).alias("score"))


# ---- writes as queries ---------------------------------------------------------------------------


@query("""
    select instrument_id, price_date, price_cents from prices where price_date < DATE '1996-01-01' and instrument_id % 3 <> 0
    union all select instrument_id, price_date, price_cents + 1 from prices where instrument_id % 3 = 0""")
def upsert_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = view(spark, sf_dir, "prices").select("instrument_id", "price_date", "price_cents")
    new = prices.where("instrument_id % 3 = 0").withColumn("price_cents", F.col("price_cents") + 1)
    return upsert.merged(prices.where("price_date < DATE '1996-01-01'"), new, ["instrument_id", "price_date"])


@query("""
    select id, coalesce(case when id % 2 = 0 then outstanding end, principal) as amount, (is_active or id % 2 = 0) as flag from instruments""")
def fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_debt(view(spark, sf_dir, "instruments"))


@query("select id, coalesce(case when id % 2 = 0 then outstanding end, principal) as amount, (is_active or id % 2 = 0) as flag from instruments")
def fill_merge_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_debt(view(spark, sf_dir, "instruments"))


def filled_debt(debt: DataFrame) -> DataFrame:
    """All debt as the old side; the newer values of every second row fill it."""
    old = debt.select("id", F.col("principal").alias("amount"), F.col("is_active").alias("flag"))
    new = debt.where("id % 2 = 0").select("id", F.col("outstanding").alias("amount"), F.lit(True).alias("flag"))
    return upsert.filled(old, new, ["id"], ["flag"])


# ---- pipelines -----------------------------------------------------------------------------------

same_sql(
    "coverage_classifier",
    "select c.id, d.debt, f.total_debt, case when f.total_debt is null then 'no_financials' when d.debt is null then 'missing_all' when d.debt < 0.5 * f.total_debt then 'missing_significant' when d.debt < 0.8 * f.total_debt then 'missing_some' when d.debt <= 1.2 * f.total_debt then 'ok' when d.debt <= 2 * f.total_debt then 'excess_some' else 'excess_significant' end as status from companies c left join (select company_id, cast(sum(coalesce(outstanding, principal, 0)) as bigint) as debt from instruments group by company_id) d on d.company_id = c.id left join (select company_id, cast(max(total_debt) * 20 as bigint) as total_debt from financials group by company_id) f on f.company_id = c.id",
)
same_sql(
    "keeper_election",
    "select company_id, instrument_type, id as keeper_id, cast(n - 1 as bigint) as n_losers from (select *, row_number() over (partition by company_id, instrument_type order by case when outstanding is null then 1 else 0 end, outstanding desc, id) as rn, count(*) over (partition by company_id, instrument_type) as n from instruments) x where rn = 1 and n > 1",
)
same_sql(
    "same_amount_outliers",
    "select d.company_id, cast(d.volume as bigint) as amount, cast(d.n as bigint) as n from (select l_suppkey as company_id, cast(l_quantity as bigint) as volume, count(*) as n from lineitem group by l_suppkey, cast(l_quantity as bigint) having count(*) >= 3) d where d.n * d.volume > 100",
)
same_sql(
    "compare_companies",
    "select c.id, c.ticker, cast(coalesce(sum(i.outstanding), 0) as bigint) as debt, round(cast(100 * coalesce(sum(case when i.instrument_type = 'senior_secured_notes' then i.outstanding end), 0) as double) / nullif(cast(sum(i.outstanding) as double), 0), 4) as secured_pct, cast(count(i.id) as bigint) as n from companies c left join instruments i on i.company_id = c.id where c.id in (1, 2, 4, 5, 7, 8, 10) group by c.id, c.ticker",
)


@query(f"""
    with y as (select unnest(range(1998, 2009)) as yr), d as (select cast(year(maturity_date) as bigint) as yr, outstanding from instruments where maturity_date >= {AS_OF} and outstanding is not null),
    s as (select least(yr, 2008) as yr, sum(outstanding) as amount, count(*) as n from d group by least(yr, 2008))
    select case when y.yr = 2008 then '2008+' else cast(y.yr as varchar) end as bucket, cast(coalesce(s.amount, 0) as bigint) as amount, cast(coalesce(s.n, 0) as bigint) as n from y left join s on s.yr = y.yr""")
def maturity_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.range(1998, 2009).toDF("yr")
    debt = view(spark, sf_dir, "instruments").where(f"maturity_date >= {AS_OF} and outstanding is not null")
    sums = debt.groupBy(F.least(F.year("maturity_date"), F.lit(2008)).cast("long").alias("yr")).agg(F.sum("outstanding").alias("amount"), F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("yr") == 2008, "2008+").otherwise(F.col("yr").cast("string"))
    return years.join(sums, "yr", "left").select(bucket.alias("bucket"), F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""
    with q as (select *, row_number() over (partition by company_id order by fiscal_year desc, fiscal_quarter desc) as nth from financials where period_end < {AS_OF}),
    t as (select company_id, sum(case when nth <= 4 and filing_type = '10-Q' then ebitda end) as e, count(case when nth <= 4 and filing_type = '10-Q' then ebitda end) as n,
                 max(case when nth = 1 then total_debt end) as debt, max(case when nth = 1 then cash end) as cash, sum(case when nth <= 4 then interest_expense end) as interest from q group by company_id),
    m as (select *, cast(floor(cast(e as double) * 4 / nullif(n, 0)) as bigint) as ebitda from t)
    select company_id, cast(debt as bigint) as total_debt, cast(debt - cash as bigint) as net_debt, ebitda, case when debt is not null and ebitda <> 0 then round(sign(cast(debt as double) / ebitda) * least(abs(cast(debt as double) / ebitda), 999.99), 4) end as leverage,
           case when cast(ebitda as double) / nullif(interest, 0) <= 999.99 then round(sign(ebitda) * least(abs(cast(ebitda as double) / nullif(interest, 0)), 999.99), 4) end as coverage, coalesce(debt > 4 * ebitda, false) as is_leveraged from m""")
def company_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "financials").where(f"period_end < {AS_OF}")
    last = ag.latest_n(rows, ["company_id"], [F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc()], 4)
    quarter = F.when(F.col("filing_type") == "10-Q", F.col("ebitda"))
    newest = lambda c: F.max(F.when(F.col("nth") == 1, F.col(c)))
    sums = last.groupBy("company_id").agg(F.sum(quarter).alias("e"), F.count(quarter).alias("k"), newest("total_debt").alias("debt"), newest("cash").alias("cash"), F.sum("interest_expense").alias("interest"))
    ebitda = F.floor(F.col("e").cast("double") * 4 / F.nullif("k", F.lit(0))).cast("long")
    sums = sums.withColumn("ebitda", ebitda)
    ratio = lambda a, b: F.col(a).cast("double") / F.nullif(b, F.lit(0))
    return sums.select("company_id", F.col("debt").alias("total_debt"), (F.col("debt") - F.col("cash")).alias("net_debt"), "ebitda", F.round(finance.capped(ratio("debt", "ebitda")), 4).alias("leverage"), F.when(ratio("ebitda", "interest") <= 999.99, F.round(finance.capped(ratio("ebitda", "interest")), 4)).alias("coverage"), F.coalesce(F.col("debt") > 4 * F.col("ebitda"), F.lit(False)).alias("is_leveraged"))


QUERIES |= {f"qc_{rule.name}": quality.registered(rule) for rule in quality.RULES}
ORACLE |= {f"qc_{rule.name}": quality.duck_sql(rule) for rule in quality.RULES}
QUERIES["quality_report"] = quality.report
ORACLE["quality_report"] = quality.report_sql()


# ---- calls ---------------------------------------------------------------------------------------


def book(spark: SparkSession, sf_dir: str) -> api.Book:
    return api.Book(**{name: view(spark, sf_dir, name) for name in api.Book.__dataclass_fields__})


@query("""
    select i.id, i.cusip, i.instrument_type, i.rate_bps, c.ticker, 0.8 as confidence from instruments i join companies c on i.company_id = c.id
    where i.rate_bps between 500 and 550 and i.maturity_date between DATE '2003-01-01' and DATE '2003-12-31' order by i.id limit 20""".replace("0.8", "cast(0.8 as double)"))
def call_resolve_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.resolve_bond(book(spark, sf_dir), q="secured 5.25%", maturity_year=2003).select("id", "cusip", "instrument_type", "rate_bps", "ticker", "confidence")


@query("""
    select i.id, i.outstanding, i.rate_bps, cast(coalesce(g.n, 0) as bigint) as n_guarantors from instruments i join companies c on i.company_id = c.id
    left join (select instrument_id, count(*) as n from guarantees group by instrument_id) g on g.instrument_id = i.id
    where i.is_active and i.rate_bps >= 820 - 1 and i.instrument_type = 'term_loan_b' and i.id in (select instrument_id from prices) and i.id in (select instrument_id from guarantees)
    order by i.outstanding desc nulls last, i.id limit 100""")
def call_search_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    page = api.search_bonds(b, instrument_type="term_loan_b", min_coupon=8.2, has_guarantors=True, has_pricing=True).sort("-outstanding").page(100)
    return api.with_guarantors(b, page).select("id", "outstanding", "rate_bps", "n_guarantors")


@query("""
    select c.id, c.ticker, d.total_debt from companies c left join (select company_id, cast(sum(outstanding) as bigint) as total_debt, bool_or(rate_type = 'floating') as f from instruments group by company_id) d on d.company_id = c.id
    where d.total_debt between 50000000 and 120000000 and coalesce(d.f, false) order by d.total_debt nulls last, c.id limit 100""")
def call_search_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_companies(book(spark, sf_dir), min_debt=50_000_000, max_debt=120_000_000, has_floating=True)
    return screen.sort("total_debt").fields("id,ticker,total_debt").page(100)


@query("""
    with l as (select company_id, max(period_end) as period_end from financials group by company_id)
    select f.company_id, f.period_end, f.revenue, f.ebitda from financials f join l on l.company_id = f.company_id and l.period_end = f.period_end where f.revenue >= 1000000 order by f.revenue desc nulls last, f.company_id, f.period_end limit 200""")
def call_latest_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_financials(book(spark, sf_dir), period="latest", min_revenue=1_000_000)
    return screen.sort("-revenue").fields("company_id,period_end,revenue,ebitda").page(200, most=200)


@query("""
    with r as (select *, row_number() over (partition by company_id order by period_end desc) as nth from financials)
    select company_id, cast(sum(revenue) as bigint) as revenue, cast(sum(interest_expense) as bigint) as interest_expense, cast(max(case when nth = 1 then cash end) as bigint) as cash, cast(count(*) as bigint) as quarters from r where nth <= 4 group by company_id""")
def call_ttm_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_financials(book(spark, sf_dir), period="TTM").df.select("company_id", "revenue", "interest_expense", "cash", "quarters")


@query("""
    with r as (select *, row_number() over (partition by company_id order by period_end desc) as nth from financials),
         k as (select company_id, filing_type as newest from r where nth = 1)
    select company_id, cast(sum(revenue) as bigint) as revenue, cast(sum(interest_expense) as bigint) as interest_expense, cast(max(case when nth = 1 then cash end) as bigint) as cash, cast(count(*) as bigint) as quarters
    from r join k using (company_id) where nth = 1 or (nth <= 4 and newest <> '10-K') group by company_id""")
def call_ltm_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_financials(book(spark, sf_dir), period="LTM").df.select("company_id", "revenue", "interest_expense", "cash", "quarters")


@query("""
    select test_metric, min_by(threshold, id) filter (where company_id = 1) as "1", min_by(threshold, id) filter (where company_id = 2) as "2", min_by(threshold, id) filter (where company_id = 3) as "3"
    from covenants where company_id in (1, 2, 3) group by test_metric""")
def call_compare_covenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.compare_covenants(book(spark, sf_dir), [1, 2, 3])


@query("""
    select e.id, e.name, 1 as depth, cast(d.debt as bigint) as debt from entities e left join (select issuer_id, sum(outstanding) as debt from instruments where is_active group by issuer_id) d on d.issuer_id = e.id where e.parent_id = 'N3'
    union all select e.id, e.name, 2, cast(d.debt as bigint) from entities e join entities p on e.parent_id = p.id left join (select issuer_id, sum(outstanding) as debt from instruments where is_active group by issuer_id) d on d.issuer_id = e.id where p.parent_id = 'N3'""")
def call_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.traverse(book(spark, sf_dir), "N3", 3).select("id", "name", "depth", "debt")


@query("select instrument_id, price_date, price_cents, volume from prices where instrument_id = 7 and price_date between DATE '1996-06-01' and DATE '1998-01-01'")
def call_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.price_history(book(spark, sf_dir), 7, date(1996, 6, 1), date(1998, 1, 1)).select("instrument_id", "price_date", "price_cents", "volume")


@query("""
    with l as (select id, case when id % 4 = 0 then rate_bps end as live, rate_bps + 7 as est from instruments),
    h as (select instrument_id, max_by(price_cents, price_date) as traded from prices where instrument_id % 3 = 0 group by instrument_id)
    select l.id, cast(coalesce(l.live, h.traded, l.est) as bigint) as price, case when l.live is not null then 'live' when h.traded is not null then 'history' else 'estimate' end as price_source from l left join h on h.instrument_id = l.id""")
def price_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    rate = F.col("rate_bps").cast("long")
    history = b.prices.where("instrument_id % 3 = 0").select(F.col("instrument_id").alias("id"), "price_date", F.col("price_cents").alias("price"))
    return api.price_waterfall(b.instruments.where("id % 4 = 0").select("id", rate.alias("price")), history, b.instruments.select("id", (rate + 7).alias("price")))


same_sql(
    "status_counters",
    "select 'companies' as name, cast(count(*) as bigint) as n, cast(count(distinct sector) as bigint) as n_distinct from companies union all select 'instruments', count(*), count(distinct company_id) from instruments union all select 'guarantees', count(*), count(distinct guarantor_id) from guarantees union all select 'prices', count(*), count(distinct instrument_id) from prices",
)
same_sql(
    "structural_subordination",
    "select e.parent_id, cast(count(distinct i.id) as bigint) as n, cast(sum(i.outstanding) as bigint) as debt, cast(count(distinct case when g.instrument_id is not null then i.id end) as bigint) as n_guaranteed from entities e join instruments i on i.issuer_id = e.id left join (select distinct instrument_id from guarantees) g on g.instrument_id = i.id group by e.parent_id",
)
same_sql(
    "guarantee_summary",
    "select i.company_id, cast(count(distinct g.guarantor_id) as bigint) as n_guarantors, cast(sum(i.outstanding) as bigint) as guaranteed from guarantees g join instruments i on i.id = g.instrument_id group by i.company_id",
)
same_sql(
    "obligor_leakage",
    "select company_id, fiscal_year, cast(sum(revenue) as bigint) as consolidated, cast(sum(case when fiscal_quarter < 4 then revenue end) as bigint) as obligor, case when sum(case when fiscal_quarter < 4 then revenue else 0 end) * 2 < sum(revenue) then 'high' when sum(case when fiscal_quarter < 4 then revenue else 0 end) * 4 < 3 * sum(revenue) then 'elevated' else 'low' end as risk from financials group by company_id, fiscal_year",
)
same_sql(
    "ownership_audit",
    "select entity_type, cast(count(*) as bigint) as n, cast(count(*) filter (where parent_id is null) as bigint) as orphans, cast(count(*) filter (where is_guarantor) as bigint) as guarantors, max(name) as last_name from entities group by entity_type",
)
same_sql(
    "history_copy",
    "select i.id, max(p.price_date) as price_date from instruments i join prices p on p.instrument_id = i.id where i.is_active and not exists (select 1 from prices x where x.instrument_id = i.id and x.price_date > DATE '2001-06-01') group by i.id",
)
same_sql(
    "fiscal_calendar",
    "select id, cast(case when quarter(issue_date) = 1 then year(issue_date) - 1 else year(issue_date) end as bigint) as fiscal_year, cast(case when quarter(issue_date) = 1 then 4 else quarter(issue_date) - 1 end as bigint) as fiscal_quarter, cast(datediff(maturity_date, issue_date) as bigint) as tenor_days from instruments where maturity_date is not null",
    "select id, cast(case when quarter(issue_date) = 1 then year(issue_date) - 1 else year(issue_date) end as bigint) as fiscal_year, cast(case when quarter(issue_date) = 1 then 4 else quarter(issue_date) - 1 end as bigint) as fiscal_quarter, cast(maturity_date - issue_date as bigint) as tenor_days from instruments where maturity_date is not null",
)


# ---- streams, run to the end of what is there ------------------------------------------------------


def streamed(df: DataFrame, mode: str) -> DataFrame:
    """The last result of a stream over the files at hand, as a table in the shared folder."""
    spark = df.sparkSession
    out = run_dir(spark, "stream")
    # a batch that runs again replaces its own folder, so no row comes twice
    sink = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={n}")
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query("""
    select cast(ts as date) as day, cast(count(*) as bigint) as n, cast(count(*) filter (where event_id % 20 <> 0 and event_id % 9 = 0) as bigint) as n_4xx,
           cast(count(*) filter (where event_id % 20 = 0) as bigint) as n_5xx, cast(sum(event_id % 100) as bigint) as latency from events group by cast(ts as date)""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streamed(counters.tumbling(counters.events(spark, sf_dir, pattern="events.parquet"), "1 day"), "complete")
    return rows.select(F.to_date("window.start").alias("day"), "n", "n_4xx", "n_5xx", "latency")


@query("select cast(date_trunc('hour', ts) as timestamp) as hour, '<100ms' as bucket, cast(count(*) as bigint) as n from events group by date_trunc('hour', ts)")
def stream_hourly_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streamed(counters.by_latency(counters.events(spark, sf_dir, pattern="events.parquet")), "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "bucket", F.col("count").alias("n"))


@query("select event_id, user_id from events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(counters.once(counters.events(spark, sf_dir, pattern="events.parquet")).select("event_id", "user_id"), "append")


@query("""
    with recursive e as (select user_id, event_id, epoch_ms(ts) as ms, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as nth from events),
    r as (select user_id, event_id, nth, ms as opened, 1 as used from e where nth = 1
        union all select e.user_id, e.event_id, e.nth, case when e.ms >= r.opened + 3600000 then e.ms else r.opened end, case when e.ms >= r.opened + 3600000 then 1 else r.used + 1 end from r join e on e.user_id = r.user_id and e.nth = r.nth + 1)
    select user_id, event_id, used <= 2 as allowed from r""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(counters.limited(counters.events(spark, sf_dir, pattern="events.parquet"), 2, 3600), "append")


# ---- texts of filings ------------------------------------------------------------------------------


@query("""
    select doc_id, cast(case when length(text) <= 300 then length(text) end as bigint) as whole, cast(len(list_distinct(regexp_extract_all(lower(text), 'apache|copyright|license'))) as bigint) as n_words from documents""")
def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(apache|copyright|license)"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") <= 300, F.length("text")).cast("long").alias("whole"), F.size(found).cast("long").alias("n_words"))


@query(rf"""
    with c as (select doc_id, text, regexp_extract(substr(text, 1, 300), '(?s)^(.{{240,}}[.!?])(?:\s|$)', 1) as e from documents)
    select doc_id, cast(case when length(text) <= 300 then length(text) when e <> '' then length(e) else 300 end as bigint) as n_chars,
        case {" ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in extraction.SECTIONS)} end as section from c""")
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(extraction.cut_at_sentence(F.col("text"), 300)).cast("long").alias("n_chars"), extraction.section_type(F.col("text")).alias("section"))


@query(f"""
    with {CLEANED}, m as (select page_id, string_split(concat(chr(10), 'text', chr(10), t), concat(chr(10), '## ')) as parts, t from cleaned),
    p as (select page_id, i as pos, case when i = 1 then concat('text', chr(10), substr(parts[1], 7)) else parts[i] end as part from (select *, unnest(range(1, len(parts) + 1)) as i from m)),
    h as (select page_id, pos, trim(string_split(part, chr(10))[1]) as heading, concat('page', chr(10), trim(part)) as chunk from p)
    select page_id, cast(pos as int) as pos, heading, cast(floor(length(chunk) / 4) as bigint) as tokens from h where heading <> ''""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("# page\n## text\n"), names.clean_html(F.col("html"))).alias("md"))
    return text.markdown_chunks(pages, "page_id", "md").select("page_id", "pos", "heading", "tokens")


@query("""
    select page_id, 0 as pos, 0 as indent, concat('A', page_id) as cells from pages
    union all select page_id, 1, cast(page_id % 4 as int), concat('N', page_id, ' x|T') from pages where page_id % 5 <> 0""")
def page_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    row = F.when(k % 5 != 0, F.concat(F.lit('<TR class="x">'), F.repeat(F.lit("<td> </td>"), (k % 4).cast("int")), F.lit("<td><b>N"), k.cast("string"), F.lit("</b> x</td><td>&nbsp;</td><th>T</th></TR>"))).otherwise("<tr><td>&nbsp;</td></tr>")
    tables = F.concat("html", F.lit("<table><tr><td>A"), k.cast("string"), F.lit("</td></tr>"), row, F.lit("<tr></tr></table>"))
    return readers.table_cells(table(spark, sf_dir, "pages").select("page_id", tables.alias("html")), "page_id", "html").withColumn("cells", F.array_join("cells", "|"))


from . import analyses, cascades, deeds, exports, filings, flows, links, loads, registers, scalars, screens, searches  # noqa: E402, F401  (they register their queries)
