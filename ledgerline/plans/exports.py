"""Queries of exports, costs, samples, and identifiers that are no identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import AS_OF, over, view
from ..durable import run_dir
from ..functions import costs
from ..operators import aggregates
from ..sources import export
from .registry import query


def projected(spark: SparkSession, sf_dir: str, what: str, columns: str, **filters: object) -> DataFrame:
    """An export, written as bulk exports are and read back."""
    book = {n: view(spark, sf_dir, n) for n in ("companies", "instruments", "metrics", "marks", "financials", "covenants")}
    frame, keys = export.export_frame(book, what, **filters)
    rows, folder = frame.select(*columns.split()), run_dir(spark, "export")
    export.bulk(rows, keys, export.MOST, folder, "json")
    return spark.read.schema(rows.schema).json(folder)


@query("""
    select c.id as company_id, c.ticker, c.sector, d.total_debt, d.instruments, m.leverage_ratio from companies c left join (select company_id, cast(sum(outstanding) as bigint) as total_debt, count(*) as instruments from instruments where is_active group by company_id) d on d.company_id = c.id
    left join metrics m on m.company_id = c.id where c.sector ilike '%mach%' order by c.id limit 50000""")
def export_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "companies", "company_id ticker sector total_debt instruments leverage_ratio", sector="mach")


@query("""
    select i.id, c.ticker, i.cusip, i.outstanding, i.maturity_date, m.last_price, m.source from instruments i join companies c on c.id = i.company_id left join marks m on m.instrument_id = i.id where i.is_active order by i.id limit 50000""")
def export_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "bonds", "id ticker cusip outstanding maturity_date last_price source")


@query("""
    select f.company_id, c.ticker, f.fiscal_year, f.fiscal_quarter, f.revenue, f.ebitda from financials f join companies c on c.id = f.company_id order by f.company_id, f.fiscal_year, f.fiscal_quarter limit 50000""")
def export_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "financials", "company_id ticker fiscal_year fiscal_quarter revenue ebitda")


@query("""
    select v.id, c.ticker, v.covenant_name, v.threshold from covenants v join companies c on c.id = v.company_id where c.ticker in ('Customer#000000001', 'Customer#000000005', 'Customer#000000009') order by v.id limit 50000""")
def export_covenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "covenants", "id ticker covenant_name threshold", tickers=["Customer#000000001", "Customer#000000005", "Customer#000000009"])


@query(f"""
    with s as (select company_id, sum(outstanding) as total, sum(outstanding * greatest(0, maturity_date - {AS_OF}) / 365.0::double) as years from instruments where is_active group by company_id)
    select company_id, case when total > 0 then round(least(coalesce(years, 0) / total, 999.9::double), 6) end as maturity from s""")
def weighted_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").where("is_active")
    return debt.groupBy("company_id").agg(F.round(aggregates.weighted_maturity(F.col("outstanding"), F.col("maturity_date"), F.expr(AS_OF)), 6).alias("maturity"))


CODES = """
    select id, company_id, is_active, case cast(id % 9 as int) when 0 then null when 1 then substr(cusip, 1, 8) when 2 then concat(substr(cusip, 1, 8), 'x') else cusip end as cusip,
        case cast(id % 8 as int) when 0 then null when 1 then concat('us', cusip, '7') when 2 then concat('US', cusip) when 3 then concat('U1', cusip, '7') when 4 then concat('US', cusip, '-') else concat('US', cusip, '7') end as isin from instruments"""


@query(f"""
    with c as ({CODES}) select id, cusip, isin from c where is_active and (id % 9 in (1, 2) or id % 8 in (1, 2, 3, 4))""")
def qc_identifier_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = over(spark, {"instruments": view(spark, sf_dir, "instruments")}, CODES)
    bad = lambda c, pattern: F.col(c).isNotNull() & ~F.col(c).rlike(pattern)
    return codes.where(F.col("is_active") & (bad("isin", "^[A-Z]{2}[A-Z0-9]{10}$") | bad("cusip", "^[A-Z0-9]{9}$"))).select("id", "cusip", "isin")


@query("""
    select id, case when id % 3 = 0 then 0 when id % 4 = 0 then 10 when id % 4 in (1, 2) then 15 else 5 end as cents,
        case when id % 3 = 0 then 19900 when id % 4 = 1 then id * 15 when id % 4 = 2 then cast(id * 10 as int) else id * 5 end as monthly from usage_log""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 4
    path = F.when(k == 0, "/v1/companies/AAPL/changes").when(k == 1, "/v1/entities/traverse").when(k == 2, "/v1/batch").otherwise("/v1/unknown")
    tier, mix = F.when(F.col("id") % 3 == 0, "pro").otherwise("pay_as_you_go"), F.when(k == 1, "advanced").when(k == 2, "balanced").otherwise("simple")
    rows = view(spark, sf_dir, "usage_log").select("id", costs.call_cost(path, tier).alias("cents"), costs.monthly_cost(tier, F.col("id"), mix).cast("bigint").alias("monthly"))
    return rows
