"""The library's calls: screens and look-ups over domain tables, all lazy until a page is taken.

A `Book` holds the tables; tests and `catalog` fill it from the test data, a user from their own. Filters
that are None don't apply. Money is in cents; percentages in arguments become basis points by
`percent_to_bps`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import coupon_bps
from ..operators import aggregates, graph, joins, text
from ..operators.screen import BadRequest, NotFound, Screen, comma_list, key_kind, percent_to_bps

MOST_DAYS = 730


@dataclass(frozen=True)
class Book:
    companies: DataFrame
    entities: DataFrame
    instruments: DataFrame
    guarantees: DataFrame
    collateral: DataFrame
    prices: DataFrame
    financials: DataFrame
    covenants: DataFrame


def bps(value: float | None) -> int | None:
    return None if value is None else percent_to_bps(value)


def by_company(book: Book, rows: DataFrame, ticker: str | None, sector: str | None) -> DataFrame:
    """Rows with a company_id of the companies with one of the tickers and a sector that holds the text; nothing is joined if neither is asked for."""
    if ticker is None and sector is None:
        return rows
    wanted = Screen(book.companies, ("id",)).is_in("ticker", comma_list(ticker) or None).contains("sector", sector)
    return rows.join(wanted.df.select(F.col("id").alias("company_id")), "company_id", "left_semi")


def search_companies(
    book: Book, ticker: str | None = None, sector: str | None = None, min_debt: int | None = None, max_debt: int | None = None, has_floating: bool | None = None,
    metrics: DataFrame | None = None, industry: str | None = None, rating_bucket: str | None = None, min_leverage: float | None = None, max_leverage: float | None = None,
    min_net_leverage: float | None = None, max_net_leverage: float | None = None, **flags: bool | None,
) -> Screen:
    """Companies with their debt. `metrics`, one row a company_id, adds its columns: those that a filter names must be
    there. `flags` are its booleans, such as has_holdco_debt=False; a company without metrics passes no filter on them."""
    debt = book.instruments.groupBy(F.col("company_id").alias("id")).agg(
        F.sum("outstanding").alias("total_debt"), F.count(F.lit(1)).alias("n_bonds"), F.bool_or(F.col("rate_type") == "floating").alias("floating"), F.min("maturity_date").alias("next_maturity")
    )
    rows = book.companies.join(debt, "id", "left")
    if metrics is not None:
        more = [c for c in metrics.columns if c not in (*rows.columns, "company_id")]
        rows = rows.join(metrics.select(F.col("company_id").alias("id"), *more), "id", "left")
    elif any(v is not None for v in (industry, rating_bucket, min_leverage, max_leverage, min_net_leverage, max_net_leverage, *flags.values())):
        raise BadRequest("a filter on metrics needs metrics")
    if unknown := sorted(set(flags) - set(rows.columns)):
        raise BadRequest(f"unknown filters: {', '.join(unknown)}")
    screen = Screen(rows, ("id",))
    screen = screen.is_in("ticker", comma_list(ticker, upper=False) or None).contains("sector", sector).between("total_debt", min_debt, max_debt)
    screen = screen.contains("industry", industry).equals(rating_bucket=rating_bucket, **flags)
    screen = screen.between("leverage_ratio", min_leverage, max_leverage).between("net_leverage_ratio", min_net_leverage, max_net_leverage)
    return screen.where(None if has_floating is None else F.coalesce("floating", F.lit(False)) == has_floating)


#: What `search_bonds(...).sort(...)` calls the columns of a traded price.
BOND_SORTS = {"maturity_date": "maturity_date", "coupon_rate": "rate_bps", "outstanding": "outstanding", "name": "name", "issuer_type": "issuer_type", "company_ticker": "ticker", "pricing.ytm": "ytm_bps", "pricing.spread": "spread_bps", "pricing.last_price": "last_price"}


def search_bonds(
    book: Book, cusip: str | None = None, sector: str | None = None, seniority: str | None = None, instrument_type: str | None = None, rate_type: str | None = None,
    min_coupon: float | None = None, max_coupon: float | None = None, min_outstanding: int | None = None, maturity_after: date | None = None, maturity_before: date | None = None,
    has_guarantors: bool | None = None, has_pricing: bool | None = None, active: bool | None = True, ticker: str | None = None, security_type: str | None = None, issuer_type: str | None = None,
    currency: str | None = None, max_outstanding: int | None = None, has_cusip: bool | None = None, marks: DataFrame | None = None,
    min_ytm: float | None = None, max_ytm: float | None = None, min_spread: int | None = None, max_spread: int | None = None,
) -> Screen:
    """Debt with its company. Filters that are False count, unlike None. The price join is made only if asked for.

    `marks` (instrument_id, last_price, ytm_bps, spread_bps, source), one row an instrument, adds these columns; with it,
    `has_pricing` asks for a price from trades (see `traded`), without it for any row in the book's prices. Filters on
    yield and spread look at all marks. `issuer_type` joins the issuers."""
    companies = book.companies.select(F.col("id").alias("company_id"), "ticker", "sector")
    rows = book.instruments.join(companies, "company_id")
    if issuer_type is not None:
        rows = rows.join(book.entities.select(F.col("id").alias("issuer_id"), F.col("entity_type").alias("issuer_type")), "issuer_id")
    if marks is not None:
        rows = rows.join(marks.select(F.col("instrument_id").alias("id"), "last_price", "ytm_bps", "spread_bps", "source"), "id", "left")
    elif any(v is not None for v in (min_ytm, max_ytm, min_spread, max_spread)):
        raise BadRequest("a filter on yield or spread needs marks")
    screen = Screen(rows, ("id",))
    screen = screen.is_in("cusip", comma_list(cusip, upper=True) or None).contains("sector", sector).is_in("seniority", comma_list(seniority) or None)
    screen = screen.is_in("ticker", comma_list(ticker) or None).present("cusip", has_cusip)
    screen = screen.equals(instrument_type=instrument_type, rate_type=rate_type, is_active=active, security_type=security_type, issuer_type=issuer_type, currency=currency and currency.upper())
    screen = screen.between("rate_bps", bps(min_coupon), bps(max_coupon))
    screen = screen.between("outstanding", min_outstanding, max_outstanding).between("maturity_date", maturity_after, maturity_before)
    screen = screen.between("ytm_bps", bps(min_ytm), bps(max_ytm)).between("spread_bps", min_spread, max_spread)
    screen = screen.having(book.guarantees, "id", "instrument_id", has_guarantors)
    if marks is None:
        return screen.having(book.prices, "id", "instrument_id", has_pricing)
    if has_pricing is None:
        return screen
    return screen.where(traded() if has_pricing else F.col("last_price").isNull())


def traded(source: str = "TRACE") -> Column:
    """There is a price and it comes from trades."""
    return F.col("last_price").isNotNull() & (F.col("source") == source)


def with_pricing(page: DataFrame) -> DataFrame:
    """A page with `pricing`, a struct that is null unless the price comes from trades; a yield of 0 counts as missing."""
    shown = F.struct(F.col("last_price").alias("last_price"), F.when(F.col("ytm_bps") != 0, F.col("ytm_bps") / 100).alias("ytm"), F.col("spread_bps").alias("spread"))
    return page.withColumn("pricing", F.when(traded(), shown)).drop("last_price", "ytm_bps", "spread_bps", "source")


def search_documents(
    book: Book, sections: DataFrame, q: str, ticker: str | None = None, doc_type: str | None = None, section_type: str | None = None, filed_after: date | None = None, filed_before: date | None = None,
    sort: str = "-relevance", types: tuple[str, ...] = (), limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of the sections (doc_id, company_id, doc_type, section_type, title, content, filed) that hold all words of
    `q`, with relevance and snippet. `sort` is -relevance, filed or -filed; any other is -relevance; ties by doc_id.
    `types` are the section types that may be asked for (none: all). Filters come before the search, snippets after the page."""
    if len(q.strip()) < 2:
        raise BadRequest("q has at least 2 letters")
    kinds = comma_list(section_type)
    if types and (unknown := sorted(set(kinds) - set(types))):
        raise BadRequest(f"unknown section types: {', '.join(unknown)}")
    some = Screen(by_company(book, sections, ticker, None), ("doc_id",)).is_in("doc_type", comma_list(doc_type) or None).is_in("section_type", kinds or None).between("filed", filed_after, filed_before)
    hits = some.df.join(text.cover_density(some.df, q, "doc_id", {"title": 1.0, "content": 0.4}).withColumnRenamed("score", "relevance"), "doc_id")
    by = sort if sort in ("filed", "-filed") else "-relevance"
    return Screen(hits, ("doc_id",)).sort(by).page(limit, offset).withColumn("snippet", text.snippet(F.col("content"), F.lit(q)))


def with_guarantors(book: Book, page: DataFrame) -> DataFrame:
    """A page enriched with its guarantor counts: the join is after the limit."""
    n = book.guarantees.groupBy(F.col("instrument_id").alias("id")).agg(F.count(F.lit(1)).alias("n_guarantors"))
    return page.join(n, "id", "left").withColumn("n_guarantors", F.coalesce("n_guarantors", F.lit(0)))


def resolve_bond(book: Book, q: str | None = None, cusip: str | None = None, ticker: str | None = None, coupon: float | None = None, maturity_year: int | None = None, limit: int = 20) -> DataFrame:
    """Bonds that a free text or its parts name, best first: a known CUSIP is certain, all else likely."""
    if not any((q, cusip, ticker)):
        raise BadRequest("one of q, cusip, ticker is needed")
    words = (q or "").split()
    if words and ticker is None and len(words[0]) <= 5 and not words[0][0].isdigit():
        ticker = words[0].upper()
    year = re.search(r"\b(20[2-5]\d|2060)\b", q or "")
    percent = re.search(r"(\d{1,2}(?:\.\d+)?)\s*%", q or "")
    maturity_year = maturity_year or (int(year[1]) if year else None)
    coupon = coupon if coupon is not None else float(percent[1]) if percent else None
    if words and cusip is None and key_kind(words[0]) == "cusip":
        cusip, ticker = words[0], None
    companies = book.companies.select(F.col("id").alias("company_id"), "ticker")
    screen = Screen(book.instruments.join(companies, "company_id"), ("id",)).equals(cusip=cusip, ticker=ticker)
    screen = screen.near("rate_bps", bps(coupon), 25 if q else 50).in_year("maturity_date", maturity_year)
    exact = F.lit(1.0 if cusip else 0.8)
    return screen.page(limit, most=20).withColumn("confidence", exact)


def traverse(book: Book, start: str, depth: int = 3, direction: str = "down", guarantors_only: bool = False) -> DataFrame:
    """(id, depth, name, entity_type, debt) of what an entity owns, or of its owners."""
    starts = book.entities.where(F.col("id") == start).select("id")
    if starts.isEmpty():
        raise NotFound(f"entity {start}")
    found = graph.descendants(book.entities, starts, depth, F.col("is_guarantor") if guarantors_only else None) if direction == "down" else graph.ancestors(book.entities, starts, depth)
    debt = book.instruments.where("is_active").groupBy(F.col("issuer_id").alias("id")).agg(F.sum("outstanding").alias("debt"))
    return found.join(book.entities.select("id", "name", "entity_type"), "id").join(debt, "id", "left")


def search_financials(
    book: Book, company: int | None = None, year: int | None = None, period: str | None = None, min_revenue: int | None = None, ticker: str | None = None, sector: str | None = None,
    quarter: int | None = None, filing_type: str | None = None, period_after: date | None = None, period_before: date | None = None, min_ebitda: int | None = None, min_cash: int | None = None,
) -> Screen:
    """`period`: `latest` (ties stay), `TTM` (the four newest rows), `LTM` (the newest alone if it is a 10-K,
    which is annual, else as `TTM`), or like `1997Q2`."""
    rows = by_company(book, book.financials, ticker, sector)
    if period and (m := re.fullmatch(r"(\d{4})Q([1-4])", period)):
        rows = rows.where((F.col("fiscal_year") == int(m[1])) & (F.col("fiscal_quarter") == int(m[2])))
    elif period == "latest":
        rows = joins.latest_ties(rows, ["company_id"], "period_end")
    elif period in ("TTM", "LTM"):
        last = aggregates.latest_n(rows, ["company_id"], [F.col("period_end").desc()], 4)
        if period == "LTM":
            newest = F.max(F.when(F.col("nth") == 1, F.col("filing_type"))).over(Window.partitionBy("company_id"))
            last = last.withColumn("newest", newest).where((F.col("nth") == 1) | F.coalesce(F.col("newest") != "10-K", F.lit(True)))
        rows = last.groupBy("company_id").agg(
            *[F.sum(c).alias(c) for c in ("revenue", "ebitda", "interest_expense")], *[F.max_by(c, "period_end").alias(c) for c in ("cash", "total_debt", "fiscal_year", "fiscal_quarter")], F.max("period_end").alias("period_end"), F.count(F.lit(1)).alias("quarters")
        )
    elif period:
        raise BadRequest("period is latest, TTM, LTM or like 1997Q2")
    screen = Screen(rows, ("company_id", "period_end")).equals(company_id=company, fiscal_year=year, fiscal_quarter=quarter, filing_type=filing_type)
    return screen.between("period_end", period_after, period_before).between("revenue", min_revenue).between("ebitda", min_ebitda).between("cash", min_cash)


def of_instruments(book: Book, rows: DataFrame, key: str, ticker: str | None, instruments: str | None, cusip: str | None, seniority: str | None = None) -> DataFrame:
    """Rows whose instrument, by `key`, is one of the ids or CUSIPs (lists with commas), of one of the tickers, and of the seniority; nothing
    is joined if none is asked for."""
    if ticker is None and instruments is None and cusip is None and seniority is None:
        return rows
    wanted = Screen(by_company(book, book.instruments, ticker, None), ("id",)).is_in("id", comma_list(instruments) or None).is_in("cusip", comma_list(cusip, upper=True) or None).equals(seniority=seniority)
    return rows.join(wanted.df.select(F.col("id").alias(key)), key, "left_semi")


def search_collateral(
    book: Book, instrument: int | None = None, kind: str | None = None, has_valuation: bool | None = None, min_value: int | None = None, ticker: str | None = None,
    instruments: str | None = None, cusip: str | None = None, priority: str | None = None, seniority: str | None = None,
) -> Screen:
    """Collateral by its instrument (one, or lists with commas of ids, CUSIPs, tickers of its company; its seniority), kind, priority and value."""
    rows = of_instruments(book, book.collateral, "instrument_id", ticker, instruments, cusip, seniority)
    return Screen(rows, ("instrument_id", "line")).equals(instrument_id=instrument, collateral_type=kind, priority=priority).present("value", has_valuation).between("value", min_value)


def search_covenants(
    book: Book, company: int | None = None, kind: str | None = None, metric: str | None = None, low: int | None = None, high: int | None = None, ticker: str | None = None,
    instruments: str | None = None, cusip: str | None = None, name: str | None = None, threshold_type: str | None = None, min_confidence: float | None = None,
) -> Screen:
    """Covenants by company (id or tickers), instrument (ids, CUSIPs), type, name in part, metric, threshold and confidence (0 to 1)."""
    rows = of_instruments(book, by_company(book, book.covenants, ticker, None), "instrument_id", None, instruments, cusip)
    screen = Screen(rows, ("id",)).equals(company_id=company, covenant_type=kind, test_metric=metric, threshold_type=threshold_type).contains("covenant_name", name).between("threshold", low, high)
    return screen.between("confidence_pct", None if min_confidence is None else min_confidence * 100)


def search_pricing(
    book: Book, marks: DataFrame, ticker: str | None = None, instruments: str | None = None, cusip: str | None = None, min_ytm: float | None = None, max_ytm: float | None = None, min_spread: int | None = None,
    max_spread: int | None = None, seniority: str | None = None, traded_only: bool = False,
) -> Screen:
    """Marks of active instruments with their instrument and ticker; yields in percent, spreads in basis points. `traded_only` leaves estimates out."""
    rows = of_instruments(book, marks, "instrument_id", ticker, instruments, cusip, seniority)
    known = book.instruments.where("is_active").select(F.col("id").alias("instrument_id"), "company_id", "name", "cusip", "seniority", "maturity_date")
    rows = rows.where("last_price is not null").join(known, "instrument_id").join(book.companies.select(F.col("id").alias("company_id"), "ticker"), "company_id")
    screen = Screen(rows, ("instrument_id",)).between("ytm_bps", bps(min_ytm), bps(max_ytm)).between("spread_bps", min_spread, max_spread)
    return screen.where(F.col("source") != "estimate" if traded_only else None)


def compare_covenants(book: Book, companies: list[int]) -> DataFrame:
    """metric x company: the first threshold by id."""
    if not 2 <= len(companies) <= 10:
        raise BadRequest("compare 2 to 10 companies")
    rows = book.covenants.where(F.col("company_id").isin(companies))
    return rows.groupBy("test_metric").pivot("company_id", companies).agg(F.min_by("threshold", "id"))


def price_history(book: Book, instrument: int, start: date | None, end: date) -> DataFrame:
    start = start or end - timedelta(days=365)
    if start > end or (end - start).days > MOST_DAYS:
        raise BadRequest(f"the range is at most {MOST_DAYS} days, in order")
    return Screen(book.prices, ("price_date",)).equals(instrument_id=instrument).between("price_date", start, end).df.orderBy("price_date")


def price_waterfall(live: DataFrame, history: DataFrame, estimates: DataFrame) -> DataFrame:
    """(id, price, price_source): the live price, else the newest traded one, else the estimate."""
    last = joins.latest_one(history.select("id", "price_date", F.col("price").alias("traded")), ["id"], ["price_date"])
    rows = estimates.select("id", F.col("price").alias("estimated")).join(live.select("id", F.col("price").alias("live")), "id", "left").join(last, "id", "left")
    source = F.when(F.col("live").isNotNull(), "live").when(F.col("traded").isNotNull(), "history").when(F.col("estimated").isNotNull(), "estimate")
    return rows.select("id", F.coalesce("live", "traded", "estimated").alias("price"), source.alias("price_source"))


def batch(operations: list[Mapping[str, Any]], known: Mapping[str, Callable[..., DataFrame]], limit: int = 100) -> dict[str, Any]:
    """Up to ten calls, one after the other; a call that fails doesn't stop the others."""
    if not 1 <= len(operations) <= 10:
        raise BadRequest("1 to 10 operations")
    results = []
    for i, op in enumerate(operations):
        try:
            df = known[op["primitive"]](**op.get("params", {}))
            results.append({"operation_id": i, "status": "success", "data": [r.asDict(recursive=True) for r in df.limit(limit).collect()], "error": None})
        except Exception as e:  # each operation answers for itself
            results.append({"operation_id": i, "status": "error", "data": None, "error": f"{type(e).__name__}: {str(e)[:200]}"})
    good = sum(r["status"] == "success" for r in results)
    return {"results": results, "meta": {"total_operations": len(results), "successful": good, "failed": len(results) - good}}


def names_to_terms(names: DataFrame, name: str) -> DataFrame:
    """Coupon read from names, beside the stored columns."""
    return names.withColumn("name_coupon_bps", coupon_bps(F.col(name)))
