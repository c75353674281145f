"""Domain views over the test tables, in SQL that Spark and DuckDB both read.

{name} stands for a base table. Money is in cents, rates in basis points, dates are plain dates.
Nulls are made on purpose: the base tables have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "DATE '1998-01-01'"

VIEWS = {
    "companies": """
        select c_custkey as id, c_name as ticker, case when c_custkey % 11 = 0 then null else c_mktsegment end as sector,
               n_name as country, c_nationkey as nation_id, c_mktsegment = 'BUILDING' as is_financial
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "entities": """
        select concat('R', r_regionkey) as id, cast(null as string) as parent_id, r_name as name, 'holdco' as entity_type,
               true as is_root, false as is_guarantor, cast(null as bigint) as company_id, false as is_unrestricted from {region}
        union all
        select concat('N', n_nationkey), concat('R', n_regionkey), n_name, 'finco', false, n_nationkey % 2 = 0, null, false from {nation}
        union all
        select concat('C', c_custkey), concat('N', c_nationkey), c_name, 'opco', false, c_custkey % 3 = 0, c_custkey, c_custkey % 50 = 0 from {customer}
        union all
        select concat('S', s_suppkey), case when s_suppkey % 10 = 0 then null else concat('C', s_suppkey) end, s_name, 'subsidiary', false, s_suppkey % 4 = 0, s_suppkey, s_suppkey % 9 = 0 from {supplier}""",
    "instruments": """
        select o_orderkey as id, o_custkey as company_id, concat('C', o_custkey) as issuer_id,
               case when o_orderkey % 17 = 0 then null else cast(round(o_totalprice * 100) as bigint) end as outstanding,
               case when o_orderkey % 13 = 0 then null else cast(round(o_totalprice * 110) as bigint) end as principal,
               cast((o_orderkey * 37) % 1200 as int) as rate_bps, case when o_orderkey % 97 = 0 then 'senior_secured' else o_orderpriority end as seniority,
               case cast(o_orderkey % 5 as int) when 0 then 'senior_notes' when 1 then 'term_loan_b' when 2 then 'revolver' when 3 then 'senior_secured_notes' else 'convertible_notes' end as instrument_type,
               case when o_orderkey % 3 = 0 then 'floating' else 'fixed' end as rate_type,
               cast(o_orderdate as date) as issue_date,
               case when o_orderkey % 19 = 0 then null else cast(o_orderdate as date) + cast((o_orderkey * 53) % 3650 as int) end as maturity_date,
               o_orderstatus <> 'F' as is_active, lpad(cast(o_orderkey as string), 9, '0') as cusip,
               concat(o_orderpriority, ' ', cast(o_orderdate as date)) as name, case when o_orderkey % 3 = 0 and o_orderkey % 21 <> 0 then 'SOFR' end as benchmark,
               o_orderkey % 23 = 0 as issue_date_estimated
        from {orders}""",
    "guarantees": """
        select distinct l_orderkey as instrument_id, l_suppkey as guarantor_id, concat('S', case when l_orderkey % 499 = 0 then -1 else l_suppkey end) as guarantor_entity,
               case when l_orderkey % 8 = 0 then 'limited' else 'full' end as guarantee_type, case when l_orderkey % 8 = 0 and l_orderkey % 24 <> 0 then 1000000 end as limitation_amount
        from {lineitem}""",
    "collateral": """
        select l_orderkey as instrument_id, l_linenumber as line, l_returnflag as collateral_type, l_linestatus as priority,
               case when l_linenumber % 4 = 0 then null else cast(round(l_extendedprice * 100) as bigint) end as value
        from {lineitem}""",
    "prices": """
        select l_partkey as instrument_id, cast(l_shipdate as date) as price_date,
               cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as amount, cast(sum(cast(l_quantity as bigint)) as bigint) as volume,
               cast(floor(cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / sum(cast(l_quantity as bigint))) as bigint) as price_cents
        from {lineitem} group by l_partkey, cast(l_shipdate as date)""",
    "financials": """
        select l_suppkey as company_id, cast(year(l_shipdate) as int) as fiscal_year, cast(quarter(l_shipdate) as int) as fiscal_quarter,
               case when quarter(l_shipdate) = 4 then '10-K' else '10-Q' end as filing_type, max(cast(l_shipdate as date)) as period_end,
               cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as revenue,
               case when l_suppkey % 7 = 0 and quarter(l_shipdate) = 2 then null when l_suppkey % 41 = 3 and quarter(l_shipdate) = 1 then cast(sum(cast(round(l_extendedprice * 200) as bigint)) as bigint) else cast(sum(cast(round(l_extendedprice * l_discount * 100) as bigint)) as bigint) end as ebitda,
               cast(sum(cast(round(l_extendedprice * l_tax * 100) as bigint)) as bigint) as interest_expense,
               cast(sum(cast(l_quantity as bigint)) * 1000 as bigint) as total_debt, cast(sum(cast(l_linenumber as bigint)) * 1000 as bigint) as cash,
               case when l_suppkey % 43 = 5 and quarter(l_shipdate) = 3 then cast(-100 as bigint) when l_suppkey % 37 = 4 and quarter(l_shipdate) = 3 then cast(100 as bigint) else cast(sum(cast(l_quantity as bigint)) * 2000 as bigint) end as total_assets
        from {lineitem} group by l_suppkey, year(l_shipdate), quarter(l_shipdate)""",
    "treasuries": """
        select cast(ts as date) as yield_date, event_type as benchmark, cast(floor(cast(sum(cast(round(value * 100) as bigint)) as double) / count(*)) as bigint) as yield_bps
        from {events} group by cast(ts as date), event_type""",
    "usage_log": """
        select event_id as id, user_id, event_type as endpoint, cast(round(value * 100) as bigint) as cost_cents, ts as created_at,
               cast(ts as date) as day, cast(event_id % 100 as int) as latency_ms,
               case when event_id % 20 = 0 then 500 when event_id % 9 = 0 then 404 else 200 end as status, props
        from {events}""",
    "covenants": """
        select l_orderkey * 10 + l_linenumber as id, case when l_orderkey % 103 = 0 then -l_suppkey else l_suppkey end as company_id, case when l_linenumber = 1 then null else l_orderkey end as instrument_id,
               case when l_linenumber = 7 and l_returnflag = 'R' then 'other' when l_returnflag = 'A' then 'financial' when l_returnflag = 'N' then 'negative' else 'incurrence' end as covenant_type,
               case when l_orderkey % 101 = 0 then null when l_linenumber % 2 = 0 then 'leverage_ratio' else 'interest_coverage' end as test_metric,
               cast(l_quantity as bigint) as threshold, case when l_linenumber = 7 then 'step_down' when l_linenumber % 3 = 0 then 'minimum' else 'maximum' end as threshold_type,
               cast(round(l_discount * 100) as bigint) as confidence_pct, cast(l_shipdate as date) as created,
               concat(case when l_linenumber % 2 = 0 then 'leverage ' else 'coverage ' end, l_returnflag) as covenant_name,
               case when l_linenumber = 4 then cast(90 + l_quantity as bigint) end as put_price_pct, case when l_orderkey % 10 = 0 then null else l_orderkey % 200 end as source_document_id
        from {lineitem}""",
    "ownership_links": "select concat('S', s_suppkey) as child_id, concat('C', s_suppkey) as parent_id, cast(s_suppkey % 11 * 10 + 1 as int) as ownership_pct from {supplier}",
    "snapshots": """
        select c_custkey as company_id, DATE '1997-06-01' + cast(c_custkey % 300 as int) as created,
               case cast(c_custkey % 10 as int) when 1 then null when 2 then '[]' else '[1]' end as debt_snapshot,
               case cast(c_custkey % 10 as int) when 3 then null when 4 then '[]' else '["R"]' end as entities_snapshot
        from {customer} where c_custkey % 4 <> 0""",
    "metrics": """
        select s_suppkey as company_id, cast(s_suppkey * 7 % 60 as double) as leverage_ratio, cast(s_suppkey * 7 % 60 as double) - 12 as net_leverage_ratio,
               cast(s_suppkey % 13 as double) - 1 as interest_coverage, cast(s_suppkey % 50 * 1000000 as bigint) as net_debt
        from {supplier} where s_suppkey % 6 <> 0""",
    "document_links": """
        select o_orderkey as instrument_id, o_orderkey % 200 as doc_id, 'governs' as relationship from {orders} where o_orderkey % 5 <> 0
        union all select o_orderkey, o_orderkey % 199, 'related' from {orders} where o_orderkey % 9 = 1""",
    "quotes": """
        select o_orderkey as instrument_id, DATE '1998-01-01' - cast(o_orderkey % 180 as int) as fetched, cast(o_orderkey * 13 % 400 as double) - 20 as price,
               cast(o_orderkey * 31 % 12000 as int) as ytm_bps, cast(o_orderkey % 700 as int) - 150 as spread_bps
        from {orders} where o_orderkey % 2 = 1""",
    "papers": """
        select o_orderkey as doc_id, o_custkey as company_id, case when o_orderkey % 3 = 0 then 'indenture' else 'credit_agreement' end as kind,
               case when o_orderkey % 3 = 1 then case when o_orderkey % 2 = 0 then 'Amended and Restated Credit Agreement' else 'Revolving Loan Agreement' end
                    when o_orderkey % 2 = 0 then concat(cast(cast(floor((o_orderkey * 37) % 1200 / 100.0) as int) as string), '.', lpad(cast((o_orderkey * 37) % 100 as string), 2, '0'), '% Senior Secured Notes due ', cast(year(cast(o_orderdate as date) + cast((o_orderkey * 53) % 3650 as int)) as string))
                    else concat('Supplement for ', lower(o_orderpriority), ' ', cast(o_orderdate as date)) end as title,
               case when o_orderkey % 3 = 1 then concat('a term loan b of $', cast(o_orderkey % 90 + 10 as string), ' million and a revolving facility')
                    else concat('interest at ', cast(cast(floor((o_orderkey * 37) % 1200 / 100.0) as int) as string), '.', lpad(cast((o_orderkey * 37) % 100 as string), 2, '0'), ' % a year until 2003 or ', cast(year(cast(o_orderdate as date) + cast((o_orderkey * 53) % 3650 as int)) as string)) end as content,
               cast(o_orderdate as date) + cast(o_orderkey % 50 as int) as filed
        from {orders} where o_orderkey % 3 <> 2""",
    "marks": """
        select o_orderkey as instrument_id, case when o_orderkey % 7 = 0 then null else cast(o_orderkey * 13 % 400 as double) - 20 end as last_price,
               cast(o_orderkey * 31 % 1200 as int) as ytm_bps, cast(o_orderkey % 700 as int) - 150 as spread_bps, case when o_orderkey % 3 = 0 then 'estimate' else 'TRACE' end as source
        from {orders} where o_orderkey % 2 = 1""",
    "price_log": "select l_partkey as instrument_id, cast(l_shipdate as date) as price_date from {lineitem}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a lazy DataFrame."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", text))})


def views(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Views and tables by name; each table is opened once."""
    needs = {n: set(re.findall(r"{(\w+)}", VIEWS.get(n, f"{{{n}}}"))) for n in names}
    opened = {t: table(spark, sf_dir, t) for t in sorted(set().union(*needs.values()))}
    return {n: spark.sql(VIEWS[n], **{t: opened[t] for t in need}) if n in VIEWS else opened[n] for n, need in needs.items()}


def duck(body: str) -> str:
    """A DuckDB statement: the domain views that the body names, then the body."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ", ".join(f"{v} as ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    if not ctes:
        return body
    rest = body.strip()
    for head in ("with recursive ", "with "):
        if rest.lower().startswith(head):
            return f"{head}{ctes}, {rest[len(head):]}"
    return f"with {ctes} {rest}"


def over(spark: SparkSession, frames: Mapping[str, DataFrame], body: str) -> DataFrame:
    """The body over frames by name."""
    text = body
    for v in frames:
        text = re.sub(rf"\b(from|join)(\s+){v}\b", rf"\1\2{{{v}}}", text)
    return spark.sql(text, **{v: f for v, f in frames.items() if f"{{{v}}}" in text})


def both(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """The same body run by Spark over the same views."""
    used = [v for v in (*VIEWS, *TABLES) if re.search(rf"\b{v}\b", body)]
    return over(spark, {v: view(spark, sf_dir, v) if v in VIEWS else table(spark, sf_dir, v) for v in used}, body)
