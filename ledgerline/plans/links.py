"""Queries of document links, repairs and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import AS_OF, table, view
from ..operators import linking
from .analyses import LATEST, SUMS, debt_totals
from .registry import query

COUPON = "list_filter(list_transform(regexp_extract_all({0}, '(\\d{{1,2}}\\.\\d{{1,4}})\\s*%', 1), lambda x: cast(x as double)), lambda x: x > 0 and x < 25 and abs(x - rate_bps / 100.0) < 0.01)"
YEAR = "list_contains(regexp_extract_all({0}, '\\b(20\\d\\d)\\b', 1), cast(year(maturity_date) as varchar))"


@query(f"""
    with p as (select i.id, d.doc_id, i.rate_bps, i.maturity_date, i.issue_date, i.seniority, i.name, d.title, d.content, d.filed from instruments i join papers d on d.company_id = i.company_id and d.kind = 'indenture' where i.instrument_type in ('senior_notes', 'senior_secured_notes', 'convertible_notes')),
    s as (select id, doc_id, least(1, case when rate_bps <> 0 and len({COUPON.format("title")}) > 0 then 0.35 when rate_bps <> 0 and len({COUPON.format("content")}) > 0 then 0.2 else 0 end
          + case when {YEAR.format("title")} and year(maturity_date) > 2000 then 0.35 when {YEAR.format("content")} and year(maturity_date) > 2000 then 0.3 else 0 end + case when title ilike '%senior secured%' and seniority = 'senior_secured' then 0.15 else 0 end
          + case when abs(filed - issue_date) <= 30 then 0.1 else 0 end + case when len(list_intersect(string_split(lower(name), ' '), string_split(lower(title), ' '))) >= 2 then 0.15 else 0 end) as score from p),
    r as (select *, row_number() over (partition by id order by round(score, 6) desc, doc_id) as nth from s where score > 0.4999)
    select id as instrument_id, doc_id, round(cast(score as double), 6) as score, case when score > 0.6999 then 'high' else 'low' end as band from r where nth = 1""")
def indenture_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonds = view(spark, sf_dir, "instruments").where("instrument_type in ('senior_notes', 'senior_secured_notes', 'convertible_notes')")
    pairs = bonds.join(view(spark, sf_dir, "papers").where("kind = 'indenture'"), "company_id")
    score = linking.indenture_score(*[F.col(c) for c in ("rate_bps", "maturity_date", "issue_date", "seniority", "name", "title", "content", "filed")])
    return linking.best_documents(pairs.select(F.col("id").alias("instrument_id"), "doc_id", F.round(score, 6).alias("score")))


@query(f"""
    with p as (select i.id, d.doc_id, i.instrument_type as kind, coalesce(i.principal, 0) as commitment, i.issue_date, lower(d.title) as title, d.content, d.filed,
                      cast(regexp_extract(d.content, 'of .(\\d+) million', 1) as double) * 1e8 as amount from instruments i join papers d on d.company_id = i.company_id and d.kind = 'credit_agreement' where i.instrument_type in ('revolver', 'term_loan_b')),
    s as (select id, doc_id, least(1, case when kind = 'revolver' and title like '%revolving%' then 0.3 else 0.2 end + case when commitment <> 0 and abs(amount - commitment) / commitment < 0.15 then 0.25 else 0 end + case when abs(filed - issue_date) <= 60 then 0.15 else 0 end
          + case when {AS_OF} - filed <= 730 then 0.15 else 0 end + case when title like '%amended and restated%' then 0.1 else 0 end + 0.1) as score from p),
    r as (select *, row_number() over (partition by id order by round(score, 6) desc, doc_id) as nth from s where score > 0.4499)
    select id as instrument_id, doc_id, round(cast(score as double), 6) as score, case when score > 0.6999 then 'high' else 'low' end as band from r where nth = 1""")
def agreement_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = view(spark, sf_dir, "instruments").where("instrument_type in ('revolver', 'term_loan_b')").withColumn("commitment", F.coalesce("principal", F.lit(0)))
    pairs = loans.join(view(spark, sf_dir, "papers").where("kind = 'credit_agreement'"), "company_id")
    score = linking.agreement_score(*[F.col(c) for c in ("instrument_type", "commitment", "issue_date", "title", "content", "filed")], F.expr(AS_OF))
    return linking.best_documents(pairs.select(F.col("id").alias("instrument_id"), "doc_id", F.round(score, 6).alias("score")), 0.45)


@query("""
    select i.id as instrument_id, d.doc_id, cast(0.85 as double) as confidence from instruments i join (select company_id, min(doc_id) as doc_id from papers where kind = 'credit_agreement' group by company_id having count(*) = 1) d on d.company_id = i.company_id
    where i.is_active and i.instrument_type in ('revolver', 'term_loan_b') and i.id not in (select instrument_id from document_links where relationship = 'related')""")
def only_agreement_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.single_agreement_links(view(spark, sf_dir, "instruments"), view(spark, sf_dir, "papers"), view(spark, sf_dir, "document_links").where("relationship = 'related'"))


@query("""
    with f as (select company_id, min(id) filter (where instrument_type in ('term_loan_b')) as loan, min(id) filter (where instrument_type not in ('term_loan_b')) as bond from instruments where is_active group by company_id)
    select c.id, case when c.id % 4 = 1 and not (covenant_type = 'financial' and test_metric is not null) then coalesce(bond, loan) else coalesce(loan, bond) end as instrument_id from covenants c join f on f.company_id = c.company_id where c.instrument_id is null""")
def covenant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "covenants").withColumn("covenant_name", F.when(F.col("id") % 4 == 1, "Change of Control offer").otherwise("Liens"))
    debt = view(spark, sf_dir, "instruments").withColumn("name", F.lit("2005"))
    return linking.covenant_targets(named, debt)


@query(f"""
    with {LATEST}, {SUMS}, x as (select company_id, reported * 300 as reported, instruments from sums join latest using (company_id) where reported > 0),
    i as (select i.*, x.reported, x.instruments, i.id % 2 = 0 as filled, i.issue_date < DATE '1995-01-01' as old from instruments i join x using (company_id) where i.is_active and i.outstanding > 0)
    select id, 'capacity' as fault from i where instruments > reported * 1.2 and instrument_type = 'revolver' union all select id, 'outlier' from i where instruments > reported * 2 and outstanding > reported and filled union all select id, 'stale' from i where instruments > reported * 1.2 and filled and old""")
def amount_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = debt_totals(spark, sf_dir).withColumn("reported", F.col("reported") * 300)
    facts = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.lit("doc_backfill").alias("amount_source"), F.col("issue_date").cast("string").alias("amount_doc_date"))))
    debt = view(spark, sf_dir, "instruments").withColumn("attributes", facts)
    tag = lambda df, fault: df.select("id", F.lit(fault).alias("fault"))
    return tag(linking.capacity_amounts(debt, totals), "capacity").unionByName(tag(linking.outliers(debt, totals), "outlier")).unionByName(tag(linking.stale_amounts(debt, totals, "1995-01-01"), "stale"))


@query("""
    with r as (select *, row_number() over (partition by company_id, instrument_type order by is_active desc, issue_date, id) as nth from instruments), a as (select company_id, instrument_type, first(outstanding order by nth) filter (where outstanding is not null) as o, first(maturity_date order by nth) filter (where maturity_date is not null) as m from r group by company_id, instrument_type)
    select r.id, coalesce(r.outstanding, a.o) as outstanding, coalesce(r.maturity_date, a.m) as maturity_date from r join a using (company_id, instrument_type) where nth = 1""")
def duplicates_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("is_active").desc(), F.col("issue_date")]
    kept, _ = linking.merged_duplicates(view(spark, sf_dir, "instruments"), ["company_id", "instrument_type"], order, "id", ["outstanding", "maturity_date"])
    return kept.select("id", "outstanding", "maturity_date")


@query("""
    with r as (select id, first_value(id) over (partition by company_id, instrument_type order by is_active desc, issue_date, id) as keeper from instruments)
    select distinct r.keeper as instrument_id, g.guarantor_id from guarantees g join r on r.id = g.instrument_id""")
def guarantees_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("is_active").desc(), F.col("issue_date")]
    _, mapping = linking.merged_duplicates(view(spark, sf_dir, "instruments"), ["company_id", "instrument_type"], order, "id", [])
    return linking.repointed(view(spark, sf_dir, "guarantees").select("instrument_id", "guarantor_id"), "instrument_id", mapping, ["instrument_id", "guarantor_id"])


@query("""
    with f as (select o_custkey as company_id, case when o_orderkey % 4 = 0 then '10-K' else '10-Q' end as form, cast(o_orderdate as date) as filed, o_orderkey as accession from orders),
    w as (select id as company_id, DATE '1997-01-01' as stored from companies where id % 3 = 0), r as (select f.*, row_number() over (partition by company_id, form order by filed desc, accession desc) as nth from f left join w using (company_id) where stored is null or filed > stored)
    select company_id, form, filed, accession from r where nth = 1""")
def filings_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("o_orderkey") % 4 == 0, "10-K").otherwise("10-Q")
    filings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), form.alias("form"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"))
    stored = view(spark, sf_dir, "companies").where("id % 3 = 0").select(F.col("id").alias("company_id"), F.lit("1997-01-01").cast("date").alias("stored"))
    return linking.new_filings(filings, stored)


@query("""
    with x as (select id, (case when maturity_date is null then 70 when maturity_date >= issue_date then 100 else 0 end + case when outstanding is null then 70 when outstanding > 10000000 then 100 else 0 end + case when rate_bps > 300 then 100 else 0 end) / 3.0 as score from instruments)
    select id, round(cast(score as double), 6) as score, case when score >= 85 then 'pass' when score >= 70 then 'needs_review' else 'fail' end as status from x""")
def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [F.col("maturity_date") >= F.col("issue_date"), F.col("outstanding") > 10_000_000, F.col("rate_bps") > 300]
    x = linking.check_score(checks)
    return view(spark, sf_dir, "instruments").select("id", F.round(x["score"], 6).alias("score"), x["status"].alias("status"))


@query("select id, case when id % 3 = 0 or maturity_date is null then replace(instrument_type, '_', ' ') || coalesce(' due ' || cast(year(maturity_date) as varchar), '') else name end as name from instruments")
def names_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat_ws(" due ", F.replace("instrument_type", F.lit("_"), F.lit(" ")), F.year("maturity_date").cast("string"))
    empty = F.when((F.col("id") % 3 != 0) & F.col("maturity_date").isNotNull(), F.col("name"))
    return view(spark, sf_dir, "instruments").select("id", F.coalesce(empty, made).alias("name"))


@query("""
    select i.company_id, cast(count(distinct i.id) as bigint) as n, cast(count(distinct d.instrument_id) as bigint) as n_linked from instruments i left join document_links d on d.instrument_id = i.id group by i.company_id having count(distinct i.id) > count(distinct d.instrument_id)""")
def partly_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "document_links").select(F.col("instrument_id").alias("id"), F.lit(True).alias("linked")).distinct()
    rows = view(spark, sf_dir, "instruments").select("id", "company_id").join(links, "id", "left")  # one row an instrument: no distinct counts
    return rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count("linked").alias("n_linked")).where("n > n_linked")


@query(f"""
    with d as (select {AS_OF} - fetched as days from quotes) select case when days <= 1 then 'fresh' when days <= 7 then 'recent' when days <= 30 then 'stale' else 'very_stale' end as label, cast(count(*) as bigint) as n, cast(min(days) as int) as least, row_number() over (order by min(days)) as nth from d group by 1""")
def staleness_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions import dates

    days = view(spark, sf_dir, "quotes").select(dates.staleness_days(F.col("fetched"), F.expr(AS_OF)).alias("days"))
    rows = days.groupBy(dates.staleness_label(F.col("days")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("days").alias("least"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("least")).cast("long"))  # four rows


@query("select a.id from instruments a where exists (select 1 from instruments b where b.id <> a.id and b.company_id = a.company_id and b.benchmark is not distinct from a.benchmark and b.instrument_type = a.instrument_type)")
def null_safe_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping takes nulls as equal, which the row-value IN over stand-ins for nulls does by hand."""
    rows = view(spark, sf_dir, "instruments")
    key = ["company_id", "benchmark", "instrument_type"]
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").alias("b")
    met = rows.alias("a").join(twice, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left_semi")
    return met.where("company_id is not null and instrument_type is not null").select("id")


@query("select id from instruments where outstanding not in (select value from collateral where value is not null and line = 1) and outstanding is not null")
def not_in_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a list with a null matches nothing: nulls go first, then an anti join says it; a null on the left matches nothing either."""
    known = view(spark, sf_dir, "collateral").where("value is not null and line = 1").select(F.col("value").alias("outstanding"))
    return view(spark, sf_dir, "instruments").where("outstanding is not null").join(known, "outstanding", "left_anti").select("id")


@query("select event_id, json_exists(cast(props as json), '$.k') as has_key from events")
def json_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_contains(F.json_object_keys("props"), "k").alias("has_key"))


@query("select id, case when rate_bps <> 0 then cast(rate_bps as double) / 100 end as rate_pct, strftime(maturity_date, '%Y-%m-%d') as matures, cast(outstanding as double) / 100 as dollars from instruments")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "instruments").select("id", F.when(F.col("rate_bps") != 0, F.col("rate_bps") / 100).alias("rate_pct"), F.date_format("maturity_date", "yyyy-MM-dd").alias("matures"), (F.col("outstanding") / 100).alias("dollars"))


@query("""
    with p as (select id from instruments order by outstanding desc nulls last, id limit 100)
    select p.id, cast(coalesce((select count(*) from guarantees g where g.instrument_id = p.id), 0) as bigint) as n_guarantors, (select string_agg(c.collateral_type, ',' order by c.line, c.collateral_type) from collateral c where c.instrument_id = p.id) as collateral from p""")
def page_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page is cut first; then one row per key of each side joins it."""
    page = view(spark, sf_dir, "instruments").orderBy(F.col("outstanding").desc_nulls_last(), "id").limit(100).select("id")
    near = lambda name: view(spark, sf_dir, name).withColumnRenamed("instrument_id", "id").join(F.broadcast(page), "id", "left_semi").groupBy("id")  # noqa: E731  (100 rows)
    guarantors = near("guarantees").agg(F.count(F.lit(1)).alias("n_guarantors"))
    kinds = near("collateral").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "collateral_type"))), lambda x: x["collateral_type"]), ",").alias("collateral"))
    return page.join(guarantors, "id", "left").join(kinds, "id", "left").select("id", F.coalesce("n_guarantors", F.lit(0)).alias("n_guarantors"), "collateral")


@query("select e.id as entity_id, i.id, i.maturity_date, row_number() over (partition by e.id order by i.maturity_date nulls last, i.id) as nth from entities e join instruments i on i.issuer_id = e.id where i.is_active")
def debt_by_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    debt = view(spark, sf_dir, "instruments").where("is_active").select("id", "maturity_date", F.col("issuer_id").alias("entity_id"))
    order = Window.partitionBy("entity_id").orderBy(F.col("maturity_date").asc_nulls_last(), "id")
    known = view(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"))
    return debt.join(known, "entity_id", "left_semi").select("entity_id", "id", "maturity_date", F.row_number().over(order).cast("long").alias("nth"))


@query("select company_id as id, cast(0 as int) as pos, cast(company_id % 3 as int) as indent, concat('Sub ', cast(company_id as varchar), ' | ', country) as cells from (select id as company_id, country from companies) x union all select id, 1, 0, concat('Nevada & Co | ', ticker) from companies")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in HTML: the indent is what stands empty before the first cell; marks and blanks go."""
    from ..sources import readers

    row = F.concat(F.lit("<table><tr class='a'>"), F.repeat(F.lit("<td>&nbsp;</td>"), (F.col("id") % 3).cast("int")), F.lit("<td><b>Sub</b> "), F.col("id").cast("string"), F.lit("</td><td> </td><TD align=right>"), F.col("country"), F.lit("</TD></tr><tr><td> </td></tr><tr><th>Nevada & Co</th><td>&nbsp;"), F.col("ticker"), F.lit("</td></tr></table>"))
    cells = readers.table_cells(view(spark, sf_dir, "companies").select("id", row.alias("html")), "id", "html")
    return cells.select("id", F.when(F.col("pos") == 0, 0).otherwise(1).alias("pos"), "indent", F.array_join("cells", " | ").alias("cells"))
