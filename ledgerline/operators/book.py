"""Analyses over a book of companies, instruments, quotes and curves. Money is in cents, rates in basis points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance

#: What trades, for pricing.
TRADED = ("senior_notes", "notes", "bonds", "debentures", "convertible_notes", "senior_secured_notes", "subordinated_notes")
#: The smallest changes that are told: of total debt in cents, and of the leverage ratio.
DEBT_CHANGE, LEVERAGE_CHANGE = 10_000_000_000, 0.5


def chosen_debt(instruments: Column, reported: Column) -> Column:
    """The sum of the instruments, unless that is nothing or less than half of what is reported."""
    sums = F.coalesce(instruments, F.lit(0))
    return F.when((reported > 0) & (sums * 2 < reported), reported).otherwise(sums)


def pricing_summary(instruments: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per company with active debt: bonds with and without CUSIP and price, market value, yield by outstanding."""
    rows = instruments.where("is_active").join(quotes.select(F.col("instrument_id").alias("id"), "price", "ytm_bps", F.lit(True).alias("quoted")), "id", "left")
    known, quoted = F.col("cusip").isNotNull(), F.col("quoted") & F.col("cusip").isNotNull()
    value = F.when(quoted & (F.col("price") != 0) & (F.col("outstanding") != 0), finance.market_value(F.col("outstanding"), F.col("price")))
    yields = quoted & (F.col("ytm_bps") != 0) & (F.col("outstanding") != 0)
    face = F.sum(F.when(yields, F.col("outstanding")))
    return rows.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_bonds"), F.count_if(~known).alias("n_no_cusip"), F.count_if(quoted).alias("n_priced"), F.count_if(known & F.col("quoted").isNull()).alias("n_unpriced"),
        F.nullif(F.sum(value), F.lit(0)).alias("market_value"), F.round(F.sum(F.when(yields, F.col("ytm_bps") / 100 * F.col("outstanding"))) / face, 2).alias("ytm_pct"),
    )


def needing_prices(instruments: DataFrame, quotes: DataFrame, today: Column, stale_days: int = 7) -> DataFrame:
    """Active, unmatured, traded debt with a coupon whose quote is missing or `stale_days` old."""
    last = quotes.groupBy(F.col("instrument_id").alias("id")).agg(F.max("fetched").alias("fetched"))
    rows = instruments.where("is_active and rate_bps is not null").where(F.col("instrument_type").isin(*TRADED) & (F.col("maturity_date") > today)).join(last, "id", "left")
    return rows.where(F.col("fetched").isNull() | (F.datediff(today, F.col("fetched")) >= stale_days))


def estimated_prices(bonds: DataFrame, treasury: DataFrame, spreads: DataFrame, today: Column) -> DataFrame:
    """bonds (rate_bps, maturity_date, rating, ...) with benchmark, spread_bps, ytm_bps, price and confidence: the
    treasury yield of the tenor plus the spread of the rating, and the price at that yield. Matured bonds are at 100.
    treasury (benchmark, yield_pct) and spreads (rating, tenor, spread) are a few rows."""
    live = F.col("maturity_date") > today
    rows = bonds.withColumn("years", F.when(live, finance.years_between(today, F.col("maturity_date"))))
    rows = finance.interpolated_spread(rows, spreads).withColumn("benchmark", finance.benchmark_tenor(F.col("years"))).join(treasury, "benchmark", "left")
    ytm = F.col("yield_pct") + F.col("spread_bps") / 100
    price = F.round(finance.price_from_yield(F.col("rate_bps") / 10_000, ytm / 100, F.col("years")), 3)
    sure = F.when(~live, "high").when(F.substring("rating", 1, 1) == "A", "medium").otherwise("low")
    return rows.select(
        *bonds.columns, F.when(live, F.col("benchmark")).otherwise("N/A").alias("benchmark"), F.when(live, F.col("spread_bps")).otherwise(0).alias("spread_bps"),
        F.when(live, (ytm * 100).cast("int")).otherwise(0).alias("ytm_bps"), F.when(live, price).otherwise(100.0).alias("price"), sure.alias("confidence"),
    )


def history_spreads(prices: DataFrame, bonds: DataFrame, curve: DataFrame) -> DataFrame:
    """prices (instrument_id, price_date, price) with ytm_bps and the spread over that day's treasury of the bond's
    tenor; curve is (yield_date, benchmark, yield_pct). Null where the bond or the curve doesn't say."""
    rows = prices.join(bonds.select(F.col("id").alias("instrument_id"), "rate_bps", "maturity_date"), "instrument_id")
    years = finance.years_between(F.col("price_date"), F.col("maturity_date"))
    rows = rows.withColumns({"ytm_bps": F.round(finance.yield_to_maturity(F.col("price"), F.col("rate_bps") / 10_000, years) * 10_000).cast("int"), "benchmark": finance.benchmark_tenor(years)})
    found = rows.join(curve.withColumnRenamed("yield_date", "price_date"), ["price_date", "benchmark"], "left")
    spread = finance.spread_bps(F.col("ytm_bps") / 100, F.col("yield_pct").cast("double"))
    return found.select("instrument_id", "price_date", "price", "ytm_bps", "benchmark", spread.alias("spread_bps"))


def key_changes(old: DataFrame, new: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """(company_id, kind, key) of what only one of (company_id, key) has: kinds name new and gone."""
    come, gone = new.join(old, ["company_id", "key"], "left_anti"), old.join(new, ["company_id", "key"], "left_anti")
    tagged = lambda df, kind: df.select("company_id", F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"))
    return tagged(come, kinds[0]).unionByName(tagged(gone, kinds[1]))


def company_changes(old_debt: DataFrame, debt: DataFrame, old_entities: DataFrame, entities: DataFrame, old_metrics: DataFrame, metrics: DataFrame, quotes: DataFrame) -> DataFrame:
    """(company_id, kind, key, previous, current): debt and entities that came or went, metrics that moved by more
    than DEBT_CHANGE or LEVERAGE_CHANGE or whose subordination risk differs, and quotes of debt on both sides.
    Metrics: (company_id, total_debt, leverage, risk); a missing total counts as 0, a missing or zero leverage isn't compared."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    keys = key_changes(old_debt, debt, ("new_debt", "removed_debt")).unionByName(key_changes(old_entities, entities, ("entity_added", "entity_removed")))
    both = old_metrics.select("company_id", *[F.col(c).alias(f"old_{c}") for c in ("total_debt", "leverage", "risk")]).join(metrics, "company_id")
    was, now = F.coalesce("old_total_debt", F.lit(0)), F.coalesce("total_debt", F.lit(0))
    moved = both.select("company_id", F.explode(F.array_compact(F.array(
        F.when(F.abs(now - was) > DEBT_CHANGE, F.struct(F.lit("total_debt").alias("key"), was.cast("string").alias("previous"), now.cast("string").alias("current"))),
        F.when((F.col("leverage") != 0) & (F.col("old_leverage") != 0) & (F.abs(F.col("leverage") - F.col("old_leverage")) > LEVERAGE_CHANGE), F.struct(F.lit("leverage_ratio").alias("key"), text("old_leverage").alias("previous"), text("leverage").alias("current"))),
        F.when(~F.col("risk").eqNullSafe(F.col("old_risk")), F.struct(F.lit("subordination_risk").alias("key"), text("old_risk").alias("previous"), text("risk").alias("current"))),
    ))).alias("x")).select("company_id", F.lit("metric").alias("kind"), "x.*")
    kept = debt.join(old_debt, ["company_id", "key"], "left_semi").join(quotes.where("ytm_bps <> 0").select(F.col("instrument_id").alias("key"), "ytm_bps"), "key")
    priced = kept.select("company_id", F.lit("pricing").alias("kind"), text("key").alias("key"), none.alias("previous"), text("ytm_bps").alias("current"))
    return keys.withColumns({"previous": none, "current": none}).unionByName(moved).unionByName(priced)


def latest_before(rows: DataFrame, keys: Sequence[str], day: str, since: Column) -> DataFrame:
    """Of each key the newest row on or before a day, as one struct per group: no sort."""
    return rows.where(F.col(day) <= since).groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), day).alias("x")).select("x.*")


def scale_errors(totals: DataFrame, high: float = 2.0, low: float = 0.1) -> DataFrame:
    """totals (company_id, instruments, reported) whose sums are out of scale, with their ratio."""
    rows = totals.where("reported > 0 and instruments > 0").withColumn("ratio", F.col("instruments").cast("double") / F.col("reported"))
    return rows.where((F.col("ratio") > high) | (F.col("ratio") < low))


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str], group: Sequence[str], order: Column, most: int) -> DataFrame:
    """Rows of several sources, the first source's first; a key comes once, `most` rows a group at most."""
    tagged = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df)
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group, *keys).orderBy("priority", order))).where("nth = 1").drop("nth")
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("priority", order, *keys))).where(F.col("nth") <= most)


def gated(condition: Column, *columns: str) -> Column:
    """A struct of columns where a condition holds, else null."""
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(*columns))


def scaled_money(text: Column, scale: Column) -> Column:
    """A number as reported, commas and all, in cents; rounded half to even. Null if it isn't a number."""
    return F.bround(F.regexp_replace(F.trim(text), ",", "").try_cast("double") * scale).cast("long")
