"""Documents and instruments that meet on facts.

What a document says and what an instrument is become rows (company, class, fact): an identifier, a description of notes, an
issuer with a maturity year or a day near its issue, a filing day near an issue, a coupon with a year, a maturity date. Both sides
meet by equality of whole facts, so only pairs with something in common are ever made, and the facts of a busy company spread by
their values. Days meet in stretches of days; days and issuers are then compared. Signals of a pair are combined as columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import written
from ..functions.names import bare_name
from . import extraction, linking, matching, text

#: Words in the types of bonds and of loans.
BONDS = ("notes", "bonds", "debentures")
LOANS = ("revolving_credit_facility", "term_loan", "revolver", "abl_facility", "credit_facility")
#: What each signal is worth; days between which dates are near.
IDENTIFIER, DESCRIPTION, SAME_ISSUE, ISSUER_YEAR, NEAR_ISSUE, FILED_AT_ISSUE, MATURITY, FILED_NEAR, COUPON_YEAR = 0.95, 0.85, 0.80, 0.75, 0.70, 0.70, 0.65, 0.55, 0.50
NEAR_DAYS = 7
#: How a document names its issuer.
NAME = r"([A-Z][A-Za-z0-9\s,.&']+?)"
BETWEEN = rf"between\s+{NAME}(?:\s*,?\s*(?:as\s+(?:Issuer|Company|Borrower)|and\s+))"
BEFORE = rf"^{NAME}\s+(?:Indenture|INDENTURE)"
LABEL = rf"(?:Issuer|Borrower|Company)[:\s]+{NAME}(?:\n|,|\.|$)"
DAY = r"([a-z]+)\s+(\d{1,2}),?\s+(\d{4})"


@dataclass(frozen=True)
class Heads:
    """How many letters of a text each fact is looked for in; None: in all of it."""

    identifiers: int | None = 50_000
    coupons: int | None = 10_000
    years: int | None = 30_000
    notes: int | None = 5_000
    between: int | None = 2_000
    label: int | None = 5_000

    def of(self, part: str, content: Column) -> Column:
        most = getattr(self, part)
        return content if most is None else F.substring(content, 1, most)


WHOLE = Heads(None, None, None, None, None, None)


def classes(kind: Column) -> Column:
    """The classes of an instrument type: bond, loan, both or none."""
    found = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(kind), w)), F.lit(name)) for name, words in (("bond", BONDS), ("loan", LOANS))]
    return F.array_compact(F.array(*found))


def issuer_name(title: Column, content: Column, heads: Heads) -> Column:
    """The issuer that a document names, between 4 and 99 letters, or null."""
    title = F.coalesce(title, F.lit(""))
    tries = (
        F.regexp_replace(F.btrim(F.regexp_extract(F.concat(title, F.lit(" "), heads.of("between", content)), BETWEEN, 1)), r",?\s*$", ""),
        F.btrim(F.regexp_extract(title, BEFORE, 1)), F.btrim(F.regexp_extract(heads.of("label", content), LABEL, 1)),
    )
    return F.coalesce(*[F.when(F.length(t).between(4, 99), t) for t in tries])


def written_day(text: Column, before: str) -> Column:
    """The first date behind `before`, in words, of this century; null if that is no date."""
    month, day, year = (F.regexp_extract(text, rf"(?i){before}\s+{DAY}", i) for i in (1, 2, 3))
    found = F.try_to_date(F.concat_ws(" ", F.initcap(F.lower(month)), day, year), "MMMM d yyyy")
    return F.when(year.try_cast("int").between(2000, 2100), found)


def fact(kind: str, *parts: Column) -> Column:
    """One string; null if a part is."""
    return F.concat(F.lit(f"{kind}:"), *[x for p in parts for x in (p.cast("string"), F.lit("|"))])


#: What both sides hold a fact with: the issuer whose it is and a day, where they matter.
HELD = "array<struct<fact:string,issuer:string,day:date>>"


def held(value: Column, issuer: Column | None = None, day: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.named_struct(F.lit("fact"), value, F.lit("issuer"), (nothing if issuer is None else issuer).cast("string"), F.lit("day"), (nothing if day is None else day).cast("date"))


def each(values: Column, make) -> Column:
    return F.coalesce(F.transform(values, make).cast(HELD), F.array().cast(HELD))


def span(day: Column) -> Column:
    """Where a day is met: in its stretch of days, so that days that are near lie in one stretch or in two that touch."""
    return F.floor(F.unix_date(day) / (2 * NEAR_DAYS + 1)).cast("int")


def near_spans(day: Column) -> Column:
    """The one or two stretches of the days that are near."""
    return F.array_distinct(F.array(span(F.date_sub(day, NEAR_DAYS)), span(F.date_add(day, NEAR_DAYS))))


def document_facts(papers: DataFrame, heads: Heads) -> DataFrame:
    """(company_id, class, doc_id, relationship, facts) of indentures, for bonds, and credit agreements, for loans."""
    body = F.coalesce("content", F.lit(""))
    both = lambda part: F.concat(F.coalesce("title", F.lit("")), F.lit(" "), heads.of(part, body))
    upper = F.upper(heads.of("identifiers", body))
    read = papers.where("kind in ('indenture', 'credit_agreement') and company_id is not null").select(
        "company_id", F.when(F.col("kind") == "indenture", "bond").otherwise("loan").alias("class"), "doc_id", "filed", matching.relationship(F.col("title")).alias("relationship"), F.nullif(bare_name(issuer_name(F.col("title"), body, heads)), F.lit("")).alias("issuer"),
        extraction.cusips(upper).alias("cusips"), extraction.isins(heads.of("identifiers", body)).alias("isins"), linking.note_descriptions(both("notes")).alias("notes"),
        text.coupons(both("coupons")).alias("coupons"), text.years(text.without_party(both("years"))).alias("years"), written_day(both("years"), r"(?:due|matur\w*)(?:\s+on)?").alias("matures"), written_day(both("years"), r"(?:dated|dated\s+as\s+of)").alias("dated"),
    )
    # the whole points that a coupon is near, as instruments have them
    about = lambda c: F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda k: F.floor(c * 100).cast("int") + k)
    near = F.array_distinct(F.flatten(F.transform("coupons", lambda c: F.filter(about(c), lambda b: F.abs(c - b / 100) < 0.01))))
    named = F.col("issuer").isNotNull()
    some = F.concat(
        each(F.col("cusips"), lambda x: held(fact("cusip", x))), each(F.col("isins"), lambda x: held(fact("isin", x))), each(F.col("notes"), lambda x: held(fact("note", x))),
        each(F.flatten(F.transform(near, lambda b: F.transform("years", lambda y: fact("coupon", b, y)))), lambda x: held(x)), F.array(held(fact("matures", F.col("matures")))).cast(HELD),
        each(F.when(named, F.col("years")), lambda y: held(fact("year", y), F.col("issuer"))), each(F.when(named, near_spans(F.col("dated"))), lambda k: held(fact("issued", k), F.col("issuer"), F.col("dated"))),
        each(near_spans(F.col("filed")), lambda k: held(fact("issued", k), None, F.col("filed"))),
    )
    return read.select("company_id", "class", "doc_id", "relationship", F.filter(some, lambda x: x["fact"].isNotNull()).alias("facts"))


def same_issuer(a: Column, b: Column) -> Column:
    """One name holds the other, or both start with the same two words."""
    two = [F.when(F.size(F.split(x, " ")) >= 2, F.substring_index(x, " ", 2)) for x in (a, b)]
    return linking.has(F.contains(a, b) | F.contains(b, a) | (two[0] == two[1]))


def instrument_facts(instruments: DataFrame) -> DataFrame:
    """(company_id, class, instrument_id, facts) of active instruments with cusip, isin and issuer."""
    known = instruments.where("is_active and company_id is not null").select(
        "company_id", F.col("id").alias("instrument_id"), classes(F.col("instrument_type")).alias("classes"), F.nullif("rate_bps", F.lit(0)).alias("bps"), F.nullif(bare_name(F.col("issuer")), F.lit("")).alias("issuer"),
        F.upper(F.replace("cusip", F.lit(" "), F.lit(""))).alias("cusip"), F.upper("isin").alias("isin"), "issue_date", "maturity_date", F.year("maturity_date").alias("year"), linking.note_descriptions(F.col("name")).alias("named"),
    )
    built = F.concat(F.format_string("%.2f", F.col("bps") / 100), F.lit("% notes "), F.col("year").cast("string"))
    notes = F.array_distinct(F.concat(F.array(built), F.coalesce("named", F.array().cast("array<string>"))))
    some = F.concat(
        F.array(
            held(fact("cusip", F.col("cusip"))), held(fact("isin", F.col("isin"))), held(fact("coupon", F.col("bps"), F.col("year"))), held(fact("matures", F.col("maturity_date"))),
            held(F.when(F.col("issuer").isNotNull(), fact("year", F.col("year"))), F.col("issuer")), held(fact("issued", span(F.col("issue_date"))), F.col("issuer"), F.col("issue_date")),
        ).cast(HELD), each(notes, lambda x: held(fact("note", x))),
    )
    return known.select("company_id", F.explode("classes").alias("class"), "instrument_id", F.filter(some, lambda x: x["fact"].isNotNull()).alias("facts"))


def reverse_links(papers: DataFrame, instruments: DataFrame, links: DataFrame, least: float = matching.KEEP, heads: Heads = Heads()) -> DataFrame:
    """(doc_id, instrument_id, score, method, relationship): for documents that nothing is linked to, the company's active
    instruments of the document's class that they tell of. The strongest signal counts; an issuer's day counts only where its
    maturity year doesn't. Nulls have no facts; documents and instruments without one in common don't appear; what is repeated is
    linked once. Texts are read where they lie: only facts are moved, a few rows an instrument and a document."""
    linked = links.select("doc_id", F.lit(True).alias("linked")).distinct()
    free = document_facts(papers, heads).join(linked, "doc_id", "left").where("linked is null")  # an anti join would be pushed below the reading and move the texts
    # not explode, for which a filter on the facts would be pushed below and work them out twice
    flat = lambda df, *keep: df.select("company_id", "class", *keep, F.explode_outer("facts").alias("x")).select("company_id", "class", *keep, "x.*")
    said = flat(free, "doc_id", "relationship").withColumnsRenamed({"issuer": "doc_issuer", "day": "doc_day"})
    met = said.join(flat(instrument_facts(instruments), "instrument_id"), ["company_id", "class", "fact"])
    off = F.abs(F.datediff("doc_day", "day"))
    met = met.where((F.col("doc_day").isNull() | (off <= NEAR_DAYS)) & (F.col("doc_issuer").isNull() | same_issuer(F.col("issuer"), F.col("doc_issuer"))))
    kind = F.substring_index("fact", ":", 1)
    met = met.select("doc_id", "relationship", "instrument_id", F.when(kind != "issued", kind).when(F.col("doc_issuer").isNull(), "filed").otherwise("day").alias("kind"), off.alias("off"))
    seen = lambda kind, same, near=None: F.max(F.when(F.col("kind") == kind, same if near is None else F.when(F.col("off") == 0, same).otherwise(near)).otherwise(0.0))
    pairs = met.groupBy("doc_id", "relationship", "instrument_id").agg(
        F.greatest(seen("cusip", IDENTIFIER), seen("isin", IDENTIFIER)).alias("identifier"), seen("note", DESCRIPTION).alias("note"), seen("year", ISSUER_YEAR).alias("year"),
        seen("day", SAME_ISSUE, NEAR_ISSUE).alias("day"), seen("filed", FILED_AT_ISSUE, FILED_NEAR).alias("filed"), seen("coupon", COUPON_YEAR).alias("coupon"), seen("matures", MATURITY).alias("matures"),
    )
    issuer = F.when(F.col("year") > 0, F.col("year")).otherwise(F.col("day"))
    method = F.when(F.col("note") > 0, "note_description").when(F.col("identifier") > 0, "identifier").when(F.col("year") > 0, "issuer_maturity").when(F.col("day") > 0, "issuer_issue_date").otherwise("reverse_match")
    return pairs.select("doc_id", "instrument_id", F.greatest("identifier", "note", issuer, "filed", "coupon", "matures").alias("score"), method.alias("method"), "relationship").where(F.col("score") >= least)


def company_links(instruments: DataFrame, papers: DataFrame, notes: DataFrame, today: Column, least: float = linking.LINKED) -> DataFrame:
    """(company_id, instrument_id, doc_id, score, relationship, source) for active instruments: bonds go to indentures, loans to credit
    agreements, and bonds that found none to footnotes (company_id, doc_id, content). What scores below `least` isn't kept."""
    active = instruments.where("is_active")
    of = lambda name: active.where(F.array_contains(classes(F.col("instrument_type")), name))
    # read twice below: kept, so that texts are read and pairs are scored once
    bonds = written(linking.all_links(of("bond"), papers.where("kind = 'indenture'"), today).withColumn("source", F.lit("indenture")), "bond-links")
    only_loans = of("loan").join(of("bond").select("id"), "id", "left_anti")
    loans = linking.all_links(only_loans, papers.where("kind = 'credit_agreement'"), today).withColumn("source", F.lit("credit_agreement"))
    rest = of("bond").join(bonds.select(F.col("instrument_id").alias("id")).distinct(), "id", "left_anti")
    told = linking.footnote_links(rest, notes, whole=True).select("instrument_id", "doc_id", F.col("confidence").alias("score"), F.lit("mentions").alias("relationship"), F.lit("footnote").alias("source"))
    found = bonds.unionByName(loans).unionByName(told).where(F.col("score") >= least - 1e-9)
    return found.join(active.select(F.col("id").alias("instrument_id"), "company_id"), "instrument_id")


def link_report(instruments: DataFrame, links: DataFrame) -> DataFrame:
    """(company_id, instruments, high, low, unmatched): a company's active instruments by their best link."""
    best = links.groupBy("instrument_id").agg(F.max("score").alias("score"))
    rows = instruments.where("is_active").select("company_id", F.col("id").alias("instrument_id")).join(best, "instrument_id", "left")
    count = lambda c: F.count_if(linking.has(c))
    return rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("instruments"), count(F.col("score") >= linking.SURE - 1e-9).alias("high"), count(F.col("score") < linking.SURE - 1e-9).alias("low"), count(F.col("score").isNull()).alias("unmatched"))
