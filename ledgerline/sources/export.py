"""Sinks: flat CSV, JSON lines, fingerprints, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import flattened
from ..operators.screen import BadRequest, Screen

MOST = 50_000


def flat(df: DataFrame) -> DataFrame:
    """Nested structs as columns named by path, in sorted order."""
    return df.select(*flattened(df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).mode("overwrite").csv(path)


def bulk(df: DataFrame, keys: tuple[str, ...], limit: int, path: str, form: str = "csv") -> None:
    """A bounded export in key order."""
    if not 1 <= limit <= MOST or form not in ("csv", "json"):
        raise BadRequest(f"limit must be 1..{MOST}, form csv or json")
    rows = df.orderBy(*keys).limit(limit)
    write_csv(rows, path) if form == "csv" else rows.write.mode("overwrite").json(path)


def export_frame(book: dict[str, DataFrame], what: str, tickers: list[str] | None = None, sector: str | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """One of four projections and its keys: companies with their debt and metrics, bonds with their marks, financials, or covenants, of
    the given tickers and of sectors that hold the text (companies and bonds only). `book` has the frames companies, instruments, metrics,
    marks, financials and covenants."""
    known = Screen(book["companies"], ("id",)).is_in("ticker", tickers).contains("sector", sector if what in ("companies", "bonds") else None).df.select(F.col("id").alias("company_id"), "ticker", "sector", "country")
    if what == "companies":
        debt = book["instruments"].where("is_active").groupBy("company_id").agg(F.sum("outstanding").alias("total_debt"), F.count(F.lit(1)).alias("instruments"))
        return known.join(debt, "company_id", "left").join(book["metrics"], "company_id", "left"), ("company_id",)
    if what == "bonds":
        marks = book["marks"].select(F.col("instrument_id").alias("id"), "last_price", "ytm_bps", "spread_bps", "source")
        rows = book["instruments"].where("is_active").join(known.select("company_id", "ticker"), "company_id").join(marks, "id", "left")
        return rows.select("id", "ticker", "name", "cusip", "instrument_type", "seniority", "outstanding", "rate_bps", "maturity_date", "last_price", "ytm_bps", "spread_bps", "source"), ("id",)
    if what == "financials":
        return book["financials"].join(known.select("company_id", "ticker"), "company_id"), ("company_id", "fiscal_year", "fiscal_quarter")
    if what == "covenants":
        return book["covenants"].join(known.select("company_id", "ticker"), "company_id"), ("id",)
    raise BadRequest("companies, bonds, financials or covenants")


def row_tag(*columns: str) -> Column:
    """A tag of one row: the digest of its JSON with sorted keys."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def result_tag(df: DataFrame) -> str:
    """A tag of a whole result that doesn't depend on the order of rows."""
    row = df.agg(F.bit_xor(F.xxhash64(*df.columns)), F.count(F.lit(1))).first()
    return f"{(row[0] or 0) & (1 << 64) - 1:016x}-{row[1]}"


def unchanged(tag: str, header: str | None) -> bool:
    """Whether an If-None-Match header names the tag."""
    names = [x.strip().removeprefix("W/").strip('"') for x in (header or "").split(",")]
    return "*" in names or tag in names


def snapshot(companies: DataFrame, entities: DataFrame, debt: DataFrame, day: str, old: DataFrame | None = None) -> DataFrame:
    """One nested row per company: entities, active debt and their total (outstanding, else principal);
    companies that have this day's snapshot are left out. Keys of all sides: company_id."""
    e = entities.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("id", "name", "entity_type"))).alias("entities"))
    amount = F.coalesce("outstanding", "principal", F.lit(0))
    d = debt.where("is_active").groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("id", "instrument_type", "outstanding", "rate_bps"))).alias("debt"), F.sum(amount).alias("total_debt"))
    out = companies.select("company_id").join(e, "company_id", "left").join(d, "company_id", "left").withColumn("snapshot_date", F.lit(day).cast("date"))
    return out if old is None else out.join(old.select("company_id", "snapshot_date"), ["company_id", "snapshot_date"], "left_anti")
