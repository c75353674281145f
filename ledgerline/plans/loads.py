"""Queries of results with drifting fields, refreshed documents, and the library's functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import over, table, view
from ..functions import sql
from ..operators import consistency, documents, refresh
from ..sources import results
from .registry import query


def drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each instrument, in one of seven states of the format."""
    rows = view(spark, sf_dir, "instruments")
    amount, day = F.col("outstanding").cast("string"), F.date_format("maturity_date", "yyyy-MM-dd")
    none = F.lit("null")
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), none)
    head = F.concat(F.lit('{"entities": [{"name": "E'), "id", F.lit('", "type": "opco"}], '))
    item = (
        F.concat(head, F.lit('"debt_instruments": [{"name": "N", "outstanding": '), F.coalesce(amount, none), F.lit(', "interest_rate": '), "rate_bps", F.lit(', "maturity_date": '), text(day), F.lit("}]}")),
        F.concat(head, F.lit('"instruments": [{"instrument_name": "N", "amount": '), text(amount), F.lit(', "rate_bps": "'), "rate_bps", F.lit('", "maturity": '), text(day), F.lit("}, 7, {}]}")),
        F.concat(head, F.lit('"debt": [{"name": "N", "outstanding": "a lot", "interest_rate": [1], "maturity_date": "soon"}]}')),
        F.concat(head, F.lit('"debt_instruments": "none"}')), F.lit("[1, 2]"), F.lit('{"entities": ['), F.lit(" "),
    )
    return rows.select("id", F.element_at(F.array(*item), (F.col("id") % 7 + 1).cast("int")).alias("text"))


@query("""
    select id, cast(0 as int) as pos, 'N' as name, case when id % 7 < 2 then outstanding end as outstanding, case when id % 7 < 2 then rate_bps end as rate_bps, case when id % 7 < 2 then maturity_date end as maturity
    from instruments where id % 7 < 3""")
def drifting_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.instruments(results.parsed_results(drifting(spark, sf_dir), "id", "text"), "id")
    return found.select("id", "pos", "name", F.col("outstanding").cast("bigint").alias("outstanding"), "rate_bps", "maturity")


@query("""
    select id, case id % 7 when 4 then 'not_object' when 5 then 'not_json' when 6 then 'empty' else 'loaded' end as status, cast(case when id % 7 < 4 then 1 else 0 end as bigint) as entities, cast(case when id % 7 < 3 then 1 else 0 end as bigint) as instruments from instruments""")
def drifting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.load_summary(results.parsed_results(drifting(spark, sf_dir), "id", "text"), "id")


@query("""
    with d as (select company_id, cast(sum(outstanding) as bigint) as total, count(*) as n from instruments where is_active group by company_id),
    t as (select company_id, bool_or(id % 90 = 1) as touched from instruments group by company_id)
    select c.id as company_id, coalesce(d.total, 0) as total_debt, coalesce(d.n, 0) as n, coalesce(t.touched, false) or c.id % 50 = 3 as rebuilt from companies c left join d on d.company_id = c.id left join t on t.company_id = c.id""")
def refreshed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a state in which some amounts were others and some companies weren't there yet, refreshed to the present."""
    entities, guarantees = view(spark, sf_dir, "entities"), view(spark, sf_dir, "guarantees")

    def tables(companies: DataFrame, instruments: DataFrame) -> dict[str, tuple[DataFrame, str]]:
        return {"companies": (companies.select("id", "ticker"), "id"), "instruments": (instruments.drop("principal"), "company_id")}

    def build(t: dict[str, DataFrame]) -> DataFrame:
        return documents.debt_documents(t["companies"], t["instruments"].withColumn("principal", F.lit(None).cast("bigint")), entities, guarantees)

    companies, debt = view(spark, sf_dir, "companies"), view(spark, sf_dir, "instruments")
    before = tables(companies.where("id % 50 <> 3"), debt.withColumn("outstanding", F.when(F.col("id") % 90 == 1, -1).otherwise(F.col("outstanding"))))
    stored = build({n: df for n, (df, _) in before.items()}).join(refresh.digests(before), "company_id")
    now = refresh.refreshed(stored, tables(companies, debt), build)
    at = lambda p: F.get_json_object("document", p).cast("long")
    return now.select("company_id", at("$.summary.total_debt").alias("total_debt"), at("$.summary.instrument_count").alias("n"), "rebuilt")


@query("""
    with i as (select id, rate_bps / 10000.0::double as coupon, (id % 9 + 1) / 100.0::double as yld, (id % 20)::double + 0.3 as years from instruments)
    select i.id, round(case when abs(yld) < 1e-4 then 0 else coupon * 50 * (1 - power(1 + yld / 2, -(floor(years * 2) + 1))) / (yld / 2) + 100 * power(1 + yld / 2, -(floor(years * 2) + 1)) end, 6) as price,
        cast(sign(yld * 100 - 4.255::double) * floor(abs((yld * 100 - 4.255::double) * 100)) as int) as spread, case id % 4 when 0 then 'IG' when 1 then 'HY-BB' when 2 then 'HY-CCC' else 'NR' end as band from i""")
def sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(sql.register(spark), {"instruments": view(spark, sf_dir, "instruments")}, """
        select id, round(price_of_yield(rate_bps / 10000D, (id % 9 + 1) / 100D, cast(id % 20 as double) + 0.3D), 6) as price, spread_in_bps((id % 9 + 1) / 100D * 100, 4.255D) as spread,
            rating_band(case id % 4 when 0 then 'A+' when 1 then 'BB-' when 2 then 'CC' else 'WR' end) as band from instruments""")  # fmt: skip


@query("""
    with l as (select user_id as doc, cast(event_id as int) as pos, cast(event_id * 7 % 5 as int) as indent from events),
    u as (select a.doc, a.pos, max(b.pos) as parent_pos from l a join l b on a.doc = b.doc and b.pos < a.pos and b.indent < a.indent group by all)
    select l.doc, l.pos, l.indent, u.parent_pos from l left join u on u.doc = l.doc and u.pos = l.pos""")
def sql_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr("user_id as doc", "cast(event_id as int) as pos", "cast(event_id * 7 % 5 as int) as indent")
    return sql.register(spark).sql("select * from parents_by_indent(table({lines}) partition by doc order by pos)", lines=lines)


@query("""
    with w as (select doc_id, regexp_extract_all(text, '(?is).{0,20}\\blicense\\b.{0,30}') as parts from documents)
    select doc_id, cast(i - 1 as int) as pos, parts[i] as part from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from w)""")
def sql_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sql.register(spark).sql("select d.doc_id, k.pos, k.part from {docs} d, lateral keyword_windows(d.text, 'license', 20, 30) k", docs=docs)


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each instrument: a top company, the issuer below it and a guarantor, with one of ten faults or none."""
    k = F.col("id") % 11
    top = F.when(k == 1, '{"name": "Top Inc", "entity_type": "opco"}').otherwise('{"name": "Top Inc", "entity_type": "holdco"}')
    owner = F.when(k == 2, "Nobody").when(k == 3, "the TOP, Inc.").otherwise("Top Inc")
    issuer = F.when(k == 4, "Other Co").when(k == 5, "Issuer Incorporated").otherwise("Issuer, Inc.")
    givers = F.when(k == 6, '["Giver LLC", "Stranger", "Stranger"]').when(k == 7, "[]").otherwise('["Giver LLC"]')
    amount = F.when(k == 8, "-5").when(k == 9, "1000000000000001").when(k == 10, '0, "principal": -7').otherwise("5000")
    text = F.concat(
        F.lit('{"entities": ['), top, F.lit(', {"name": "Issuer, Inc.", "owners": [{"parent_name": "'), owner, F.lit('"}, {"pct": 5}]}, {"name": "Giver LLC", "parent_name": "Top Inc"}], "debt_instruments": [{"name": "N", "issuer_name": "'),
        issuer, F.lit('", "guarantor_names": '), givers, F.lit(', "outstanding": '), amount, F.lit("}]}"),
    )
    return view(spark, sf_dir, "instruments").select("id", F.when(F.col("id") % 97 == 0, "{").otherwise(text).alias("text"))


@query("""
    select id, case id % 11 when 1 then 'no_holdco' when 2 then 'parent' when 4 then 'issuer' when 6 then 'guarantor' when 9 then 'large_amount' else 'negative_amount' end as issue,
        case id % 11 when 1 then null when 2 then 'Issuer, Inc.' else 'N' end as subject, case id % 11 when 2 then 'Nobody' when 4 then 'Other Co' when 6 then 'Stranger' when 8 then '-5.00' when 9 then '1000000000000001.00' when 10 then '-7.00' end as named
    from instruments where id % 97 <> 0 and id % 11 in (1, 2, 4, 6, 8, 9, 10)""")
def result_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.issues(results.parsed_results(structures(spark, sf_dir), "id", "text"), "id")


@query("""
    with c as (select id, case when id % 97 = 0 then 'skip' when id % 11 in (1, 2, 4, 6, 8, 9, 10) then 'fail' else 'pass' end as own, case id % 3 when 0 then 'pass' when 1 then 'warn' end as a, case id % 5 when 0 then 'warn' else 'pass' end as b from instruments),
    s as (select *, list_filter([own, a, b], lambda x: x in ('pass', 'warn', 'fail')) as l from c),
    p as (select *, list_sum(list_transform(l, lambda x: case x when 'pass' then 100.0::double when 'warn' then 70 else 0 end)) / len(l) as score, len(list_filter(l, lambda x: x = 'warn')) as w from s)
    select id, own, round(score, 4) as score, case when own = 'fail' then 'fail' when w > 1 or score < 80 then 'needs_review' else 'pass' end as status, cast(w + case when own = 'fail' then 1 else 0 end as int) as review from p""")
def result_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = consistency.consistency(results.parsed_results(structures(spark, sf_dir), "id", "text"), "id")
    a, b = F.when(F.col("id") % 3 == 0, "pass").when(F.col("id") % 3 == 1, "warn"), F.when(F.col("id") % 5 == 0, "warn").otherwise("pass")
    rows = own.select("id", F.col("status").alias("own"), consistency.verdict([F.col("status"), a, b]).alias("v"))
    return rows.select("id", "own", F.round("v.score", 4).alias("score"), "v.status", "v.review")
