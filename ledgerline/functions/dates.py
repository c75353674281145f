"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date formats tried, in order.
FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyyMMdd", "MM-dd-yyyy", "yyyy/MM/dd")
#: Assumed tenor in years by instrument type, for estimated issue dates.
TENORS = {"senior_notes": 8, "senior_secured_notes": 7, "term_loan_b": 7, "term_loan_a": 5, "revolver": 5, "convertible_notes": 5, "commercial_paper": 1}


def parse_date(text: Column) -> Column:
    """The first format that fits; a bare year is its last day."""
    t = F.trim(text)
    year = F.when(t.rlike(r"^(19|20)\d\d$"), F.make_date(t.try_cast("int"), F.lit(12), F.lit(31)))
    return F.coalesce(year, *[F.try_to_date(t, f) for f in FORMATS])


def fiscal_period(period_end: Column, filing_type: Column) -> Column:
    """{year, quarter} of a period end; an annual report is the fourth quarter."""
    q = F.when(filing_type == "10-K", 4).otherwise(F.ceil(F.month(period_end) / 3)).cast("int")
    return F.struct(F.year(period_end).alias("fiscal_year"), q.alias("fiscal_quarter"))


def filing_period(filed: Column) -> Column:
    """{year, quarter} that a filing date reports on: the quarter before it."""
    q = F.quarter(filed)
    return F.struct(F.when(q == 1, F.year(filed) - 1).otherwise(F.year(filed)).alias("fiscal_year"), F.when(q == 1, 4).otherwise(q - 1).alias("fiscal_quarter"))


def estimated_issue(maturity: Column, instrument_type: Column, name: Column) -> Column:
    """Maturity less the tenor: "N-year" in the name, else by type, else 7 years."""
    stated = F.regexp_extract(name, r"(\d{1,2})[- ][Yy]ear", 1)
    table = F.create_map(*[F.lit(x) for kv in TENORS.items() for x in kv])
    years = F.coalesce(F.when(stated != "", stated).cast("int"), F.try_element_at(table, instrument_type), F.lit(7))
    return F.add_months(maturity, -12 * years)


def staleness_days(traded: Column, as_of: Column) -> Column:
    """Days since the trade; 999 without one, never negative."""
    return F.when(traded.isNull(), 999).otherwise(F.greatest(F.datediff(as_of, traded), F.lit(0)))


def staleness_label(days: Column) -> Column:
    return F.when(days <= 1, "fresh").when(days <= 7, "recent").when(days <= 30, "stale").otherwise("very_stale")


def two_digit_year(y: Column) -> Column:
    return F.when(y < 50, 2000 + y).otherwise(1900 + y)


def eastern_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))
