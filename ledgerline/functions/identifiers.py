"""CUSIP and ISIN check digits as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"


def _values(text: Column) -> Column:
    """The value of each character, from 0; -1 for others."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def cusip_check_digit(base: Column) -> Column:
    """The ninth character of eight: every second value doubles, digits add up. Null for another shape."""
    total = F.aggregate(
        F.transform(_values(F.upper(base)), lambda v, i: F.when(i % 2 == 1, v * 2).otherwise(v)),
        F.lit(0), lambda acc, v: acc + F.floor(v / 10).cast("int") + v % 10,
    )
    return F.when(F.upper(base).rlike(r"^[0-9A-Z*@#]{8}$"), ((10 - total % 10) % 10).cast("string"))


def is_cusip(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.coalesce((F.length(t) == 9) & (F.substring(t, 9, 1) == cusip_check_digit(F.substring(t, 1, 8))), F.lit(False))


def normal_cusip(text: Column) -> Column:
    """Eight characters get their check digit, nine a right one; other shapes are null."""
    t = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    base = F.substring(t, 1, 8)
    return F.when(F.length(t).isin(8, 9), F.concat(base, cusip_check_digit(base)))


def isin_check_digit(base: Column) -> Column:
    """The twelfth character of eleven: letters as two digits, then Luhn from the right."""
    digits = F.filter(F.split(F.array_join(F.transform(_values(F.upper(base)), lambda v: v.cast("string")), ""), ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int"))),
        F.lit(0), lambda acc, v: acc + F.floor(v / 10).cast("int") + v % 10,
    )
    return F.when(F.upper(base).rlike(r"^[A-Z]{2}[0-9A-Z]{9}$"), ((10 - total % 10) % 10).cast("string"))


def is_isin(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.coalesce((F.length(t) == 12) & (F.substring(t, 12, 1) == isin_check_digit(F.substring(t, 1, 11))), F.lit(False))


def cusip_to_isin(cusip: Column, country: str = "US") -> Column:
    base = F.concat(F.lit(country), normal_cusip(cusip))
    return F.concat(base, isin_check_digit(base))


def isin_to_cusip(isin: Column) -> Column:
    t = F.upper(F.trim(isin))
    return F.when(is_isin(t) & t.rlike(r"^(US|CA)"), F.substring(t, 3, 9))


def issuer_code(cusip: Column) -> Column:
    return F.substring(cusip, 1, 6)
