"""Queries of register entries, fallback links and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import AS_OF, table, view
from ..operators import documents, linking, ownership
from .catalog import book
from .registry import query
from .scalars import pick

#: Names of instruments, and what stands for the missing document of each.
NAMES = (
    ("Commercial Paper", "commercial_paper"), ("CP program", "commercial_paper"), ("Uncommitted line", "bilateral_facility"), ("Loan from an affiliate", "intercompany"),
    ("Local facility", "foreign_local_facility"), ("non-U.S. credit line", "foreign_local_facility"), ("Receivables facility A", "securitization"), ("Sale-leaseback", "finance_lease"),
    ("fhlb advance", "government_financing"), ("Wind farm loan", "project_finance"), ("Letter of Credit", "letters_of_credit"), ("Other long-term debt", "aggregated_other"),
    ("5% Senior Notes due 2030", None), ("Another letter of credit", None),
)
EXPECTED = ", ".join(f"({i}, {'null' if reason is None else repr(reason)})" for i, (_, reason) in enumerate(NAMES))


@query(f"select i.id, case when i.id % 29 = 0 then 'finance_lease' else e.reason end as reason from instruments i join (values {EXPECTED}) e(k, reason) on e.k = i.id % {len(NAMES)}")
def documents_not_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "instruments").withColumn("name", F.element_at(F.array(*[F.lit(n) for n, _ in NAMES]), (F.col("id") % len(NAMES) + 1).cast("int")))
    lease = F.col("id") % 29 == 0
    return rows.select("id", linking.no_document(F.when(lease, "Finance_Lease").otherwise("senior_notes"), F.when(~lease, F.col("name"))).alias("reason"))


@query("""
    with d as (select *, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 2 else 1 end as rank from papers where kind = 'indenture'),
    r as (select *, row_number() over (partition by company_id order by rank desc, filed desc, doc_id) as nth from d where rank is not null)
    select i.id as instrument_id, r.doc_id, cast(case when r.rank = 2 then 0.6 else 0.55 end as double) as confidence from instruments i join r on r.company_id = i.company_id and r.nth = 1
    where i.is_active and i.instrument_type in ('senior_notes', 'senior_secured_notes', 'convertible_notes') and i.id not in (select instrument_id from document_links)""")
def base_indentures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    title = F.when(k == 0, "Officer's Certificate under the Indenture").when(k == 1, "Indenture").when(k == 2, "Supplemental Indenture").otherwise("First Indenture")
    content = F.when(k == 1, F.concat(F.lit("notes unlimited as to aggregate principal "), "content")).otherwise(F.col("content"))
    return linking.base_indenture_links(view(spark, sf_dir, "instruments"), view(spark, sf_dir, "papers").withColumn("title", title).withColumn("content", content), view(spark, sf_dir, "document_links"))


@query("""
    with p as (select i.id as instrument_id, d.doc_id from instruments i join papers d on d.company_id = i.company_id and d.kind = 'indenture'
               where i.rate_bps <> 0 and i.maturity_date is not null and regexp_matches(d.content, replace(regexp_replace(printf('%.2f', i.rate_bps / 100.0), '\\.?0+$', ''), '.', '[.]') || '\\s*%.*\\b' || year(i.maturity_date) || '\\b')),
    r as (select *, row_number() over (partition by instrument_id order by doc_id) as nth from p)
    select instrument_id, doc_id, cast(0.65 as double) as confidence from r where nth <= 3""")
def footnote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = view(spark, sf_dir, "papers").where("kind = 'indenture'").withColumn("content", F.concat("content", F.lit(" for senior notes"), F.repeat(F.lit(" and more"), F.lit(12))))
    return linking.footnote_links(view(spark, sf_dir, "instruments"), notes)


@query("""
    with n as (select id, company_id, instrument_type, printf('%.2f', rate_bps / 100.0) as rate, cast(year(maturity_date) as varchar) as maturity from instruments where is_active and maturity_date is not null and id not in (select instrument_id from document_links where relationship = 'related')),
    p as (select n.id as instrument_id, d.doc_id, round(cast(case when contains(lower(d.content), n.rate) then 0.4 else 0 end + case when contains(lower(d.content), n.maturity) then 0.3 else 0 end
          + case when n.instrument_type = 'revolver' and d.content ilike '%revolv%' then 0.3 else 0 end + case when n.instrument_type like '%notes%' and d.kind = 'indenture' then 0.2 else 0 end as double), 6) as score from n join papers d on d.company_id = n.company_id),
    r as (select *, row_number() over (partition by instrument_id order by score desc, doc_id) as nth from p where score > 0.4999)
    select instrument_id, doc_id, score, case when score > 0.6999 then 'high' else 'low' end as band from r where nth = 1""")
def plain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "instruments").where("maturity_date is not null").withColumn("name", F.concat(F.format_string("%.2f", F.col("rate_bps") / 100), F.lit("% Senior Notes due "), F.year("maturity_date")))
    papers = view(spark, sf_dir, "papers").withColumn("content", F.concat("content", F.repeat(F.lit(" and more"), F.lit(40))))
    return linking.plain_links(named, papers, view(spark, sf_dir, "document_links").where("relationship = 'related'"))


@query("""
    select n_nationkey as id, 'LEI' || n_nationkey as lei, round(cast(0.9 + case when n_nationkey % 2 = 0 then 0.1 else 0 end as double), 6) as score
    from nation where n_nationkey % 3 = 0""")
def register_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    entities = nations.select(key.alias("id"), F.concat(F.md5("n_name"), F.lit(", LLC")).alias("name"), F.lit("State of Delaware").alias("jurisdiction"))
    entries = nations.select(
        F.concat(F.lit("LEI"), key.cast("string")).alias("lei"), F.concat(F.upper(F.md5("n_name")), F.lit(" Inc.")).alias("name"), F.when(key % 3 == 0, "US").otherwise("FR").alias("country"),
        F.lit(None).cast("string").alias("jurisdiction"), F.when(key % 2 == 0, "ISSUED").otherwise("LAPSED").alias("status"),
    )
    return ownership.register_matches(entities, entries)


@query("""
    select id, parent_id from entities where parent_id like 'R%' and not is_guarantor and cast(substr(id, 2) as int) % 3 <> 0 and cast(substr(id, 2) as int) % 5 <> 1""")
def parents_without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("id", 2, 20).cast("int")
    attributes = pick("json", '{"gleif_lei": "X"}', '{"gleif_lei": ""}', None)
    rows = view(spark, sf_dir, "entities").withColumn("json", k % 3).withColumns({"attributes": attributes, "tier": F.lit(3), "is_borrower": F.lit(False)})
    links = rows.select(F.col("id").alias("child_id"), F.when(k % 5 == 1, '{"source": "filing"}').otherwise('{"source": "exhibit_21"}').alias("attributes"))
    return ownership.unsupported_parents(rows, links)


@query("""
    with g as (select instrument_id, count(*) as n, min(e.name) as first from (select distinct instrument_id, guarantor_entity from guarantees) x join entities e on e.id = x.guarantor_entity group by instrument_id),
    d as (select company_id, cast(sum(outstanding) as bigint) as total, cast(count(*) as bigint) as n, min(maturity_date) as nearest, min(i.id) as first_id, max(i.id) as last_id, cast(arg_min(coalesce(g.n, 0), i.id) as bigint) as givers, cast(sum(coalesce(outstanding, 0)) filter (where seniority = '1-URGENT') as bigint) as urgent
          from instruments i left join g on g.instrument_id = i.id where i.is_active group by company_id)
    select c.id as company_id, c.ticker, coalesce(d.total, 0) as total_debt, coalesce(d.n, 0) as n, strftime(d.nearest, '%Y-%m-%d') as nearest, d.first_id, d.last_id, d.givers, case when d.givers > 0 then f.first end as giver, d.urgent
    from companies c left join d on d.company_id = c.id left join g f on f.instrument_id = d.first_id""")
def company_debt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    d = documents.debt_documents(b.companies, b.instruments, b.entities, b.guarantees)
    at = lambda path: F.get_json_object("document", path)
    number = {"total_debt": "$.summary.total_debt", "n": "$.summary.instrument_count", "first_id": "$.instruments[0].id", "givers": "$.instruments[0].guarantor_count", "urgent": "$.summary.debt_by_seniority.1-URGENT"}
    ids = F.from_json(at("$.instruments"), "array<struct<id: bigint>>").getField("id")
    return d.select("company_id", at("$.company.ticker").alias("ticker"), *[at(p).cast("long").alias(n) for n, p in number.items()], F.try_element_at(ids, F.lit(-1)).alias("last_id"), at("$.summary.nearest_maturity").alias("nearest"), at("$.instruments[0].guarantors[0]").alias("giver"))


@query("""
    with recursive n as (select id, parent_id, name from entities), roots as (select id from n where parent_id is null)
    select r.id, cast(1 + (select count(*) from n a where a.parent_id = r.id) + (select count(*) from n a join n b on b.parent_id = a.id where a.parent_id = r.id)
        + (select count(*) from n a join n b on b.parent_id = a.id join n c on c.parent_id = b.id where a.parent_id = r.id) as bigint) as n_nodes, (select min(a.id) from n a where a.parent_id = r.id) as first_child from roots r""")
def entity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.tree_documents(view(spark, sf_dir, "entities"), ["id", "name", "entity_type"], 3)
    return d.select("id", F.size(F.regexp_extract_all("document", F.lit('("children":)'), F.lit(1))).cast("long").alias("n_nodes"), F.get_json_object("document", "$.children[0].id").alias("first_child"))


@query("""
    with p as (select i.id, d.doc_id, i.rate_bps, year(i.maturity_date) as maturity, abs(d.filed - i.issue_date) as days, d.title, d.content from instruments i join papers d on d.company_id = i.company_id and d.kind = 'indenture'),
    n as (select *, regexp_extract(title, '^(\\d+[.]\\d\\d)% Senior Secured Notes due (\\d{4})', 1) as rate, regexp_extract(title, ' Notes due (\\d{4})', 1) as year from p),
    s as (select id, doc_id, title, greatest(case when rate_bps <> 0 and rate <> '' and round(cast(nullif(rate, '') as double) * 100) = rate_bps and year = cast(maturity as varchar) then 0.9 else 0 end, case when days = 0 then 0.85 when days <= 7 then 0.75 else 0 end,
        case when rate_bps > 0 and rate_bps < 2500 and maturity > 2000 and (contains(title, cast(maturity as varchar)) or contains(content, cast(maturity as varchar)))
              and len(list_filter(regexp_extract_all(title || ' ' || content, '(\\d{1,2}[.]\\d{1,4})\\s*%', 1), lambda x: abs(cast(x as double) - rate_bps / 100.0) < 0.01)) > 0 then 0.55 else 0 end) as score from n)
    select id as instrument_id, doc_id, cast(score as double) as score, case when title ilike '%supplement%' then 'supplements' when title ilike '%amend%' then 'amends' else 'governs' end as relationship from s where score >= 0.4""")
def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonds = view(spark, sf_dir, "instruments").withColumn("issuer", F.lit(None).cast("string"))
    return linking.all_links(bonds, view(spark, sf_dir, "papers").where("kind = 'indenture'"), F.expr(AS_OF))
