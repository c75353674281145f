"""Queries of the calls with the rest of their filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import view
from . import api
from .catalog import book
from .registry import query


@query("""
    select i.id, c.ticker, i.outstanding, m.last_price, m.ytm_bps, case when m.ytm_bps <> 0 then m.ytm_bps / 100.0 end as ytm, m.spread_bps
    from instruments i join companies c on c.id = i.company_id join entities e on e.id = i.issuer_id left join marks m on m.instrument_id = i.id
    where i.is_active and e.entity_type = 'opco' and m.ytm_bps between 200 and 900 and m.spread_bps >= -50 and i.outstanding <= 20000000 and m.last_price is not null and m.source = 'TRACE' and i.cusip is not null
    order by m.ytm_bps desc nulls last, i.id limit 100""")
def call_search_bonds_by_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_bonds(book(spark, sf_dir), marks=view(spark, sf_dir, "marks"), issuer_type="opco", min_ytm=2, max_ytm=9, min_spread=-50, max_outstanding=20_000_000, has_pricing=True, has_cusip=True)
    page = screen.sort("-pricing.ytm", api.BOND_SORTS).page(100)
    shown = api.with_pricing(page.withColumn("bps", F.col("ytm_bps")))
    return shown.select("id", "ticker", "outstanding", F.col("pricing.last_price").alias("last_price"), F.col("bps").alias("ytm_bps"), F.col("pricing.ytm").alias("ytm"), F.col("pricing.spread").alias("spread_bps"))


@query("""
    select cast(count(*) as bigint) as n, cast(sum(i.id) as bigint) as ids, cast(count(m.last_price) filter (where m.source = 'TRACE') as bigint) as shown
    from instruments i join companies c on c.id = i.company_id left join marks m on m.instrument_id = i.id where i.is_active and i.rate_type = 'fixed'""")
def priced_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = api.with_pricing(api.search_bonds(book(spark, sf_dir), marks=view(spark, sf_dir, "marks"), rate_type="fixed").df)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count("pricing").alias("shown"))


@query("""
    select c.id, c.ticker, m.leverage_ratio, m.net_leverage_ratio, m.interest_coverage from companies c join metrics m on m.company_id = c.id
    where m.leverage_ratio between 10 and 40 and m.net_leverage_ratio <= 25 and c.sector ilike '%build%' order by m.leverage_ratio desc nulls last, c.id limit 100""")
def call_search_companies_by_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_companies(book(spark, sf_dir), sector="build", metrics=view(spark, sf_dir, "metrics"), min_leverage=10, max_leverage=40, max_net_leverage=25)
    return screen.sort("-leverage_ratio").fields("id,ticker,leverage_ratio,net_leverage_ratio,interest_coverage").page(100)


@query("""
    select f.company_id, f.period_end, f.revenue, f.ebitda, f.cash from financials f join companies c on c.id = f.company_id
    where c.sector ilike '%build%' and f.filing_type = '10-K' and f.fiscal_quarter = 4 and f.period_end between DATE '1994-01-01' and DATE '1997-12-31' and f.ebitda >= 100000 and f.cash >= 500
    order by f.period_end desc nulls last, f.company_id limit 200""")
def call_search_annual_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_financials(book(spark, sf_dir), sector="build", quarter=4, filing_type="10-K", period_after=date(1994, 1, 1), period_before=date(1997, 12, 31), min_ebitda=100_000, min_cash=500)
    return screen.sort("-period_end").fields("company_id,period_end,revenue,ebitda,cash").page(200, most=200)


@query("""
    with w as (select doc_id, filed, unnest(regexp_extract_all(lower(title), '([a-z0-9]+)')) as word, generate_subscripts(regexp_extract_all(lower(title), '([a-z0-9]+)'), 1) as pos, 1.0 as inverse from papers where kind = 'credit_agreement' and filed >= DATE '1995-01-01'
               union all select doc_id, filed, unnest(regexp_extract_all(lower(content), '([a-z0-9]+)')), generate_subscripts(regexp_extract_all(lower(content), '([a-z0-9]+)'), 1) + len(regexp_extract_all(lower(title), '([a-z0-9]+)')), 2.5 from papers where kind = 'credit_agreement' and filed >= DATE '1995-01-01'),
    h as (select * from w where word in ('revolving', 'loan')),
    c as (select a.doc_id, a.pos as first, b.pos as last from h a join h b on b.doc_id = a.doc_id and b.word <> a.word and b.pos > a.pos),
    m as (select * from c where not exists (select 1 from c x where x.doc_id = c.doc_id and x.first >= c.first and x.last <= c.last and (x.first > c.first or x.last < c.last))),
    v as (select m.doc_id, m.first, m.last, count(*) as n, sum(h.inverse) as inverse from m join h on h.doc_id = m.doc_id and h.pos between m.first and m.last group by m.doc_id, m.first, m.last),
    s as (select doc_id, round(cast(sum(n / inverse / (1 + last - first - (n - 1))) as double), 4) as relevance from v group by doc_id)
    select s.doc_id, p.company_id, p.filed, s.relevance from s join papers p on p.doc_id = s.doc_id order by s.relevance desc, s.doc_id limit 100""")
def call_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = view(spark, sf_dir, "papers").withColumns({"doc_type": F.lit("8-K"), "section_type": F.col("kind")})
    page = api.search_documents(book(spark, sf_dir), sections, "the revolving loans", doc_type="8-K", section_type="credit_agreement", filed_after=date(1995, 1, 1), types=("credit_agreement", "indenture"), limit=100)
    return page.select("doc_id", "company_id", "filed", "relevance")


@query("""
    select l.instrument_id, l.line, l.collateral_type, l.value from collateral l join instruments i on i.id = l.instrument_id join companies c on c.id = i.company_id
    where c.ticker in ('Customer#000000007', 'Customer#000000010', 'Customer#000000020', 'Customer#000000100') and i.seniority = '1-URGENT' and l.priority = 'F' and l.value >= 100000
    order by l.value desc nulls last, l.instrument_id, l.line limit 100""")
def call_search_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickers = "Customer#000000007, Customer#000000010,Customer#000000020,,Customer#000000100"
    screen = api.search_collateral(book(spark, sf_dir), ticker=tickers, seniority="1-URGENT", priority="F", min_value=100_000, has_valuation=True)
    return screen.sort("-value").fields("instrument_id,line,collateral_type,value").page(100)


@query("""
    select id, company_id, covenant_name, threshold from covenants where covenant_name ilike '%rage n%' and threshold_type = 'maximum' and confidence_pct >= 5 and threshold between 10 and 40 and covenant_type = 'negative'
    order by threshold desc nulls last, id limit 100""")
def call_search_covenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_covenants(book(spark, sf_dir), kind="negative", name="RAGE n", threshold_type="maximum", min_confidence=0.05, low=10, high=40)
    return screen.sort("-threshold").fields("id,company_id,covenant_name,threshold").page(100)


@query("""
    select v.id, v.company_id, v.test_metric from covenants v join instruments i on i.id = v.instrument_id where i.cusip in ('000000033', '000000064', '000000099') order by v.id limit 100""")
def call_covenants_of_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_covenants(book(spark, sf_dir), cusip="000000033,000000064, 000000099").sort("id").fields("id,company_id,test_metric").page(100)


@query("""
    select m.instrument_id, c.ticker, m.last_price, m.ytm_bps, m.spread_bps, m.source from marks m join instruments i on i.id = m.instrument_id join companies c on c.id = i.company_id
    where i.is_active and m.last_price is not null and m.ytm_bps between 300 and 800 and m.spread_bps <= 400 and m.source <> 'estimate' and i.seniority = '5-LOW' order by m.ytm_bps desc nulls last, m.instrument_id limit 100""")
def call_search_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = api.search_pricing(book(spark, sf_dir), view(spark, sf_dir, "marks"), min_ytm=3, max_ytm=8, max_spread=400, seniority="5-LOW", traded_only=True)
    return screen.sort("-ytm_bps").fields("instrument_id,ticker,last_price,ytm_bps,spread_bps,source").page(100)
