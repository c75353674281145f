"""Bond and ratio arithmetic. Rates are fractions where they are named rate or yield, basis points where named bps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ratings as letters, agencies' forms side by side, from the best.
RATINGS = (("AAA", "Aaa"), ("AA+", "Aa1"), ("AA", "Aa2"), ("AA-", "Aa3"), ("A+", "A1"), ("A", "A2"), ("A-", "A3"), ("BBB+", "Baa1"), ("BBB", "Baa2"), ("BBB-", "Baa3"), ("BB+", "Ba1"), ("BB", "Ba2"), ("BB-", "Ba3"), ("B+", "B1"), ("B", "B2"), ("B-", "B3"), ("CCC+", "Caa1"), ("CCC", "Caa2"), ("CCC-", "Caa3"), ("CC", "Ca"), ("C", "C"))
#: Upper ends in years of the benchmark tenors.
TENOR_ENDS = ((0.25, "3M"), (0.75, "6M"), (1.5, "1Y"), (2.5, "2Y"), (4.0, "3Y"), (6.0, "5Y"), (8.5, "7Y"), (15.0, "10Y"), (25.0, "20Y"))
TENORS = (1, 3, 5, 7, 10, 30)


def safe_ratio(top: Column, bottom: Column, factor: float = 1.0, digits: int = 2) -> Column:
    return F.when((top != 0) & (bottom != 0), F.bround(top / bottom * factor, digits))


def margin(part: Column, revenue: Column) -> Column:
    return F.when((revenue > 0) & part.isNotNull(), F.bround(part / revenue * 100, 2))


def free_cash_flow(operating: Column, capex: Column) -> Column:
    return operating - F.abs(F.coalesce(capex, F.lit(0)))


def capped(value: Column, most: float = 999.99) -> Column:
    return F.signum(value) * F.least(F.abs(value), F.lit(most))


def leakage(consolidated: Column, group: Column) -> Column:
    share = F.when(consolidated != 0, (consolidated - group) * 100.0 / consolidated)
    risk = F.when(share > 50, "high").when(share > 25, "elevated").when(share > 10, "moderate").otherwise("low")
    return F.struct(share.alias("leakage_pct"), F.when(share.isNotNull(), risk).alias("risk"))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)


def periods(years: Column) -> Column:
    """Whole half-years to maturity: one is always left."""
    return F.floor(years * 2) + 1


def price_from_yield(coupon: Column, yld: Column, years: Column) -> Column:
    """Per 100 of face, semi-annual, without accrued interest; at a yield near 0 the flows add up."""
    n, c, y = periods(years), coupon * 50, yld / 2
    return F.when(F.abs(yld) < 1e-4, 100 + c * n).otherwise(c * (1 - F.pow(1 + y, -n)) / F.when(y != 0, y) + 100 * F.pow(1 + y, -n))


@F.pandas_udf(T.DoubleType())
def yield_to_maturity(price: pd.Series, coupon: pd.Series, years: pd.Series) -> pd.Series:
    """The yield at which price_from_yield gives the price, by safeguarded Newton steps over whole
    columns, between -50 and 200 percent; null where there is none."""
    p, c, t = (s.to_numpy(dtype=float, na_value=np.nan) for s in (price, coupon, years))
    n = np.floor(t * 2) + 1
    ok = (p > 0) & (t > 0) & ~np.isnan(c)
    lo, hi = np.full(len(p), -0.5), np.full(len(p), 2.0)
    y = np.clip(np.where(ok, c + (100 - p) / 100 / np.where(ok, t, 1), 0.05), -0.4, 1.9)
    with np.errstate(all="ignore"):
        for _ in range(100):
            h = y / 2
            h = np.where(np.abs(h) < 1e-9, 1e-9, h)
            d = (1 + h) ** -n
            value = c * 50 * (1 - d) / h + 100 * d
            lo, hi = np.where(value > p, y, lo), np.where(value < p, y, hi)
            slope = (c * 50 * (n * d / (1 + h) * h - (1 - d)) / h**2 - 100 * n * d / (1 + h)) / 2
            step = y - (value - p) / slope
            nxt = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
            if np.nanmax(np.abs(np.where(ok, nxt - y, 0.0)), initial=0.0) < 1e-12:
                break
            y = nxt
    edge = (y <= -0.4999) | (y >= 1.9999)
    return pd.Series(np.where(ok & ~edge, y, np.nan))


def modified_duration(coupon: Column, yld: Column, years: Column) -> Column:
    """Minus the relative slope of the price, by a symmetric difference of one basis point."""
    step = 1e-4
    return (price_from_yield(coupon, yld - step, years) - price_from_yield(coupon, yld + step, years)) / (2 * step * price_from_yield(coupon, yld, years))


def dv01(coupon: Column, yld: Column, years: Column) -> Column:
    return modified_duration(coupon, yld, years) * price_from_yield(coupon, yld, years) / 10_000


def benchmark_tenor(years: Column) -> Column:
    out = F.when(years.isNull(), None)
    for end, name in TENOR_ENDS:
        out = out.when(years <= end, name)
    return out.otherwise("30Y")


def spread_bps(yield_pct: Column, treasury_pct: Column) -> Column:
    """Truncated toward zero."""
    x = (yield_pct - treasury_pct) * 100
    return (F.signum(x) * F.floor(F.abs(x))).cast("int")


def market_value(outstanding: Column, price: Column) -> Column:
    return F.floor(outstanding * price / 100).cast("long")


def normal_rating(text: Column) -> Column:
    forms = {form.upper(): pair[0] for pair in RATINGS for form in pair}
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(text))), F.lit("NR"))


def rating_bucket(rating: Column) -> Column:
    """Investment grade down to BBB-; the three bands below; else NR."""
    letters = F.regexp_extract(rating, r"^[A-D]+", 0)
    return F.when(letters.isin("AAA", "AA", "A", "BBB"), "IG").when(letters == "BB", "HY-BB").when(letters == "B", "HY-B").when(letters.isin("CCC", "CC", "C"), "HY-CCC").otherwise("NR")


def interpolated_spread(bonds: DataFrame, curve: DataFrame) -> DataFrame:
    """bonds (rating, years, ...) with spread_bps from curve (rating, tenor, spread): linear between the two
    nearest tenors, flat beyond the ends, truncated; null without years or rating. Segments are few per rating: an equality join."""
    w = F.expr("lead(struct(tenor, spread)) over (partition by rating order by tenor)")
    first = F.expr("row_number() over (partition by rating order by tenor)")
    seg = curve.select("rating", F.col("tenor").alias("lo"), F.col("spread").alias("lo_spread"), w.alias("nxt"), first.alias("nth"))
    seg = seg.select("rating", "lo", "lo_spread", F.col("nxt.tenor").alias("hi"), F.col("nxt.spread").alias("hi_spread"), "nth")
    inside = ((F.col("years") >= F.col("lo")) | (F.col("nth") == 1)) & ((F.col("years") < F.col("hi")) | F.col("hi").isNull())
    at = F.greatest(F.col("years"), F.col("lo"))
    line = F.col("lo_spread") + (F.col("hi_spread") - F.col("lo_spread")) * (at - F.col("lo")) / (F.col("hi") - F.col("lo"))
    unknown = F.col("years").isNull() & (F.col("nth") == 1)
    joined = bonds.join(seg, "rating", "left").where(inside | F.col("lo").isNull() | unknown)
    return joined.withColumn("spread_bps", F.when(F.col("years").isNotNull(), F.floor(F.coalesce(line, F.col("lo_spread"))).cast("int"))).drop("lo", "lo_spread", "hi", "hi_spread", "nth")
