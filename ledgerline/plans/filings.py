"""Named queries over filings. Filings are made of the given texts and pages with planted parts, so that what must be
found is known: the SQL says it from the plan of the planting, or by another way through the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import both, table, view
from ..operators import filings
from .registry import query

HEAD = '<?xml version="1.0"?><html><ix:header><ix:hidden><ix:nonNumeric name="dei:DocumentType" contextRef="c0">10-K</ix:nonNumeric></ix:hidden></ix:header>'
TAIL = '<div><ix:continuation id="k1"> and more &amp; more</ix:continuation></div><ix:nonFraction name="us-gaap:Cash" contextRef="c2" unitRef="usd" scale="6">&#8212;</ix:nonFraction><ix:nonNumeric name="x:Open" contextRef="c3">left <b>open'


def inline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with facts around: hidden, nested, with an excluded part, continued, without a number, never closed."""
    sign = F.when(F.col("page_id") % 3 == 0, ' sign="-"').otherwise("")
    debt = F.concat(F.lit('<p><ix:nonNumeric name="us-gaap:DebtPolicy" contextRef="c1" continuedAt="k1">Owed: $ <ix:nonFraction name="us-gaap:Debt" contextRef="c1" unitRef="usd" scale="3"'), sign, F.lit(">"), F.col("page_id").cast("string"), F.lit(",500.25</ix:nonFraction> <ix:exclude>Table of contents</ix:exclude>thousand</ix:nonNumeric></p>"))
    whole = F.concat(F.lit(HEAD), debt, "html", F.lit(TAIL))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 50 == 7, F.lit(None)).otherwise(whole).alias("html"))


@query("""
    with p as (select page_id from pages where page_id % 50 <> 7)
    select page_id, 0 as pos, 'nonnumeric' as kind, 'dei:DocumentType' as name, 'c0' as context, null as unit, 0 as scale, true as hidden, '10-K' as text, cast(null as bigint) as value from p
    union all select page_id, 1, 'nonnumeric', 'us-gaap:DebtPolicy', 'c1', null, 0, false, concat('Owed: $ ', page_id, ',500.25 thousand and more & more'), null from p
    union all select page_id, 2, 'nonfraction', 'us-gaap:Debt', 'c1', 'usd', 3, false, concat(page_id, ',500.25'), case when page_id % 3 = 0 then -1 else 1 end * (page_id * 1000000 + 500250) from p
    union all select page_id, 3, 'nonfraction', 'us-gaap:Cash', 'c2', 'usd', 6, false, '—', 0 from p
    union all select page_id, 4, 'nonnumeric', 'x:Open', 'c3', null, 0, false, 'left open', null from p""")
def inline_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filings.inline_facts(inline_pages(spark, sf_dir), "page_id", "html")
    return found.select("page_id", "pos", "kind", "name", "context", "unit", "scale", "hidden", "text", F.col("value").cast("bigint").alias("value"))


@query(r"""
    with raw as (
        select page_id, replace(replace(html, '<article>', '<ix:hidden><p>no</p></ix:hidden>it&#8217;s&#x41;&#169;&nbsp;<article>'), '<b>', '<ix:nonNumeric name="x">') as html from pages where page_id % 9 <> 4
    ), cut as (
        select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!DOCTYPE[^>]*>', '', 'g'), '(?i)<script[^>]*>[\s\S]*?</script>', '', 'g'), '(?i)<style[^>]*>[\s\S]*?</style>', '', 'g'), '(?i)<ix:hidden[^>]*>[\s\S]*?</ix:hidden>', '', 'g') as t from raw
    ), bare as (
        select page_id, regexp_replace(regexp_replace(t, '<ix:[^>]*>([^<]*)</ix:[^>]*>', '\1', 'g'), '<[^>]+>', ' ', 'g') as t from cut
    ), read as (
        select page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#8217;', '’'), '&#x41;', 'A'), '&#169;', '©') as t from bare
    ), done as (
        select page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) as t from read
        union all select page_id, concat('plain ', html) from pages where page_id % 9 = 4
    )
    select page_id, cast(length(t) as bigint) as n_chars, md5(t) as digest from done""")
def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.replace(F.replace("html", F.lit("<article>"), F.lit("<ix:hidden><p>no</p></ix:hidden>it&#8217;s&#x41;&#169;&nbsp;<article>")), F.lit("<b>"), F.lit('<ix:nonNumeric name="x">'))
    source = F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("plain "), "html")).otherwise(planted)
    text = filings.filing_text(F.col("source"))
    return table(spark, sf_dir, "pages").select("page_id", source.alias("source")).select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


LINES = 9


def exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of LINES subsidiaries for each page, in one of five forms; indents follow from page and line."""
    page, n = F.col("page_id"), F.col("page_id") % 5
    rows = [F.lit('<table><tr><td>List of Subsidiaries</td><td>Jurisdiction</td></tr><tr><td>&#160;</td></tr>')]
    flat = [F.lit("<div>EXHIBIT</div>")]
    for j in range(LINES):
        name = F.concat(F.lit("Unit "), page.cast("string"), F.lit(f"-{j} A&amp;B LLC"))
        indent = ((page + j) * (j + 3) % 4).cast("int")
        place = F.when((page + j) % 3 == 0, f"Place {j}").otherwise("")
        cells = F.concat(F.repeat(F.lit("<td> </td>"), indent), F.lit('<td class="x">'), name, F.lit("</td><td>"), place, F.lit("</td>"))
        hard = F.concat(F.lit("<td>"), F.repeat(F.lit("&#160;&nbsp;"), indent), name, F.when(place != "", F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(""), F.lit("</td>"))
        pad = F.concat(F.lit('<td><p style="padding-left: '), (indent * 15 + 7).cast("string"), F.lit('px">'), name, F.lit("</p></td><td>"), place, F.lit("</td>"))
        rows.append(F.concat(F.lit("<TR>"), F.when(n == 0, cells).when(n == 1, hard).otherwise(pad), F.lit("</TR>\n")))
        bracket = F.when(place != "", F.concat(F.lit(" ("), place, F.lit(")"))).otherwise("")
        head = F.when((n == 4) & F.lit(j % 4 == 2), "<p><font>NEW YORK</font></p>").otherwise("")
        tag = F.when(n == 3, "div").otherwise("p")
        flat.append(F.concat(head, F.lit("<"), tag, F.lit("> <font size=1>"), name, bracket, F.lit("</font></"), tag, F.lit(">")))
    html = F.when(n < 3, F.concat(F.lit("<script>var t='<tr><td>Script Row Inc</td></tr>'</script>"), *rows, F.lit("</table>"))).otherwise(F.concat(*flat))
    return table(spark, sf_dir, "pages").select("page_id", F.when(page % 40 == 9, F.lit(None)).otherwise(html).alias("html"))


@query(f"""
    with lines as (
        select page_id, cast(j as int) as pos, concat('Unit ', page_id, '-', j, ' A&B LLC') as name,
               case when page_id % 5 < 3 then cast((page_id + j) * (j + 3) % 4 as int) else 0 end as indent,
               case when (page_id + j) % 3 = 0 then concat('Place ', j) when page_id % 5 = 4 and j >= 2 then 'New York' end as jurisdiction
        from pages cross join (select unnest(range({LINES})) as j) where page_id % 40 <> 9
    ), up as (
        select a.page_id, a.pos, max(b.pos) as parent_pos from lines a join lines b on a.page_id = b.page_id and b.pos < a.pos and b.indent < a.indent group by all
    )
    select l.page_id, l.pos, l.name, l.jurisdiction, l.indent, u.parent_pos, p.name as parent_name, case when l.indent <= 1 then 'direct' else 'indirect' end as ownership_type
    from lines l left join up u on u.page_id = l.page_id and u.pos = l.pos left join lines p on p.page_id = l.page_id and p.pos = u.parent_pos""")
def exhibit_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.exhibit_hierarchy(exhibits(spark, sf_dir), "page_id", "html")


FILINGS = """
    select id, form, concat('See Exhibit 21 below. ', t, case when id % 4 < 3 then ' Subsidiaries of the Registrant ' else ' Subsidiaries of Acme Holdings Inc. ' end,
        case when id % 2 = 0 then 'Delaware and Nevada, ' else 'Auditor consent of 1998, ' end, t, ' Exhibit 22: Guarantor  Subsidiaries ', t, ' Exhibit 31 ',
        case when id % 5 = 0 then 'Note 5 - Long-Term Debt. ' when id % 5 = 1 then 'NOTE 12—Notes Payable ' when id % 5 = 2 then 'Note 3: Deposits and Borrowings ' when id % 5 = 3 then '7. Long Term Obligations ' else 'The components of debt ' end,
        t, ' ', t, ' Note 6: Leases ', case when id % 7 = 0 then 'Capital Resources and Liquidity ' else 'Liquidity and Capital Resources ' end, t, ' Item 7 ', 'Debt Covenants ', t, ' Events of Default ',
        case when id % 4 = 0 then 'Term Loan Agreement ' else 'Credit Agreement ' end, t, t, ' Exhibit 10 ', case when id % 4 = 1 then 'First Supplemental Indenture ' else 'Indenture dated ' end, t, t, t, ' EXHIBIT A end') as body
    from (select doc_id as id, case cast(doc_id % 3 as int) when 0 then '10-K' when 1 then '10-Q' else '8-K' end as form, translate(text, concat(chr(9), chr(10), chr(13)), '   ') as t from documents)"""


def section_sql(s: filings.Section) -> str:
    """The section by the place of the first opening, as a literal, and of the first end behind."""
    forms = ", ".join(f"'{f}'" for f in s.forms)
    tries = []
    for opening, end in s.openings():
        cut = f"(select {{'title': m, 'after': ltrim(substr(body, strpos(body, m) + length(m)))}} from (select regexp_extract(body, '(?i){opening}') as m) where m <> '')"
        tail = f"(select {{'title': x.title, 'head': substr(x.after, 1, {s.least}), 'tail': substr(x.after, {s.least + 1})}} from (select {cut} as x) where length(x.after) >= {s.least})"
        ended = f"(select {{'title': y.title, 'content': trim(concat(y.head, case when e = '' then y.tail else substr(y.tail, 1, strpos(y.tail, e) - 1) end))}} from (select y, regexp_extract(y.tail, '(?i){end}') as e from (select {tail} as y)) where y is not null)"
        tries.append(ended)
    return f"select id, '{s.kind}' as section_type, coalesce({', '.join(tries)}) as s from f where form in ({forms})"


def flagged_sql(flags: tuple[str, ...], text: str) -> str:
    return " + ".join(f"cast(contains({text}, '{f}') as int)" for f in flags)


@query(f"""
    with f as materialized ({FILINGS}), found as ({' union all '.join(map(section_sql, filings.SECTIONS))}),
    fine as (
        select id, section_type, s.title as section_title, regexp_replace(s.content, ' {{3,}}', '  ', 'g') as content, lower(s.content) as low, s.content as whole from found where s is not null
    )
    select id, section_type, section_title, cast(length(content) as bigint) as n_chars, md5(content) as digest from fine
    where case section_type
          when 'exhibit_21' then length(whole) >= 200 and {flagged_sql(filings.RED_FLAGS, 'substr(low, 1, 500)')} = 0 and {flagged_sql(filings.GREEN_FLAGS, 'low')} >= case when contains(low, 'subsidiaries') then 1 else 2 end
          when 'exhibit_22' then length(whole) > 200 else true end""")
def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filings.filing_sections(both(spark, sf_dir, FILINGS), "id", "form", "body")
    return found.select("id", "section_type", "section_title", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for most quarters: the stored figures as they are, 5 or 50 percent off, a thousand times too large, or unsaid; scale
    statements change inside the text."""
    # dollars of the statement's unit: thousands for revenue, millions for debt
    off = F.element_at(F.array(*map(F.lit, (100, 105, 150, 100_000, 100))), (F.col("company_id") % 5 + 1).cast("int"))
    cents = lambda c: F.floor(F.col(c) * off / 100).cast("long")
    revenue = F.format_number(F.floor(cents("revenue") / 100_000).cast("long"), 0)
    debt = F.col("total_debt") * off
    text = F.concat(
        F.lit("Consolidated statements (amounts in thousands, except per share). "), F.when(F.col("company_id") % 5 == 4, "Nothing else. ").otherwise(F.concat(F.lit("Total net revenues $ "), revenue, F.lit(" for the year. "))),
        F.lit("Debt schedule, dollars in millions: "), F.when(F.col("fiscal_quarter") == 2, "Total long-term debt ").otherwise("Total borrowings $"), (debt / 100).cast("decimal(20,0)").cast("string"), F.lit(". End."),
    )
    rows = view(spark, sf_dir, "financials").where("fiscal_year <> 1995")
    return rows.select("company_id", "fiscal_year", "fiscal_quarter", text.alias("text"))


@query("""
    with f as (select company_id, fiscal_year, fiscal_quarter, revenue, total_debt, cast([100, 105, 150, 100000, 100][company_id % 5 + 1] as bigint) as off from financials),
    said as (
        select *, 'revenue' as field, revenue as stored, case when fiscal_year <> 1995 and company_id % 5 <> 4 then cast(floor(floor(revenue * off / 100.0) / 100000) as bigint) * 100000 end as stated,
               case when company_id % 5 <> 4 then 'thousands' end as unit from f
        union all
        select *, 'total_debt', total_debt, case when fiscal_year <> 1995 then cast(round(total_debt * off / 100.0) as bigint) * 100000000 end, 'millions' from f
    ), off as (select *, case when stated <> 0 then round(abs(stored - cast(stated as double)) / cast(stated as double) * 100, 4) end as variance_pct from said where stored <> 0)
    select company_id, fiscal_year, fiscal_quarter, field, cast(stored as bigint) as stored, cast(stated as bigint) as stated, case when fiscal_year <> 1995 then unit end as unit, variance_pct,
           case when fiscal_year = 1995 then 'no_source' when variance_pct is null then 'not_stated' when variance_pct < 10 then 'match' when variance_pct > 1000 then 'scale_error' else 'mismatch' end as verdict
    from off""")
def stated_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["company_id", "fiscal_year", "fiscal_quarter"]
    found = filings.checked_figures(view(spark, sf_dir, "financials"), statements(spark, sf_dir), keys, "text")
    return found.select(*keys, "field", F.col("stored").cast("bigint").alias("stored"), F.col("stated").cast("bigint").alias("stated"), "unit", "variance_pct", "verdict")
