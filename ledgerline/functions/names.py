"""Names, slugs, and what instrument names say."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company suffixes and their short forms.
SUFFIXES = {"corporation": "corp", "incorporated": "inc", "limited": "ltd", "company": "co", "l\\.l\\.c": "llc", "l\\.p": "lp", "corp": "corp", "inc": "inc", "ltd": "ltd", "llc": "llc", "lp": "lp", "co": "co", "plc": "plc"}
#: Instrument types by what their names contain, tried in order.
TYPE_WORDS = (
    ("convertible_notes", "convertible"), ("senior_secured_notes", "senior secured note|first lien note"), ("subordinated_notes", "subordinated"),
    ("term_loan_a", "term loan a"), ("term_loan_b", "term loan|tlb"), ("revolver", "revolv|credit facility|abl"), ("commercial_paper", "commercial paper"),
    ("senior_notes", "note|bond|debenture"),
)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once, in lambdas too."""
    return F.get(F.transform(F.array(value), then), 0)


def normal_name(name: Column) -> Column:
    """Lower case, single spaces, no leading "the", and the last suffix in its short form without marks."""
    whole = "|".join(sorted(SUFFIXES, key=len, reverse=True))

    def ended(n: Column) -> Column:
        return once(F.regexp_extract(n, rf"[, ]+({whole})\.?$", 1), lambda found: shortened(n, found))

    def shortened(n: Column, found: Column) -> Column:
        short = reduce(lambda acc, kv: acc.when(found.rlike(f"^{kv[0]}$"), kv[1]), SUFFIXES.items(), F.when(found == "", ""))
        stem = F.regexp_replace(n, rf"[, ]+({whole})\.?$", "")
        return F.coalesce(F.when(found == "", F.regexp_replace(n, r"\.+$", "")).otherwise(F.concat_ws(" ", stem, short)), F.lit(""))

    return once(F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), r"^the ", ""), ended)


def bare_name(name: Column) -> Column:
    """The name without suffixes and marks."""
    n = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N} ]", " ")
    words = "|".join(sorted({k.replace("\\.", "") for k in SUFFIXES}, key=len, reverse=True))
    return F.trim(F.regexp_replace(F.regexp_replace(n, rf"\b({words})\b", " "), r"\s+", " "))


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 255)


def coupon_bps(name: Column) -> Column:
    """The first percentage in a name, in basis points: 5.25% or 5 1/4%."""
    plain = F.regexp_extract(name, r"(\d{1,2}(?:\.\d+)?)\s*%", 1)
    parts = [F.regexp_extract(name, r"(\d{1,2})[- ](\d)/(\d{1,2})\s*%", i) for i in (1, 2, 3)]
    mixed = parts[0].try_cast("double") * 100 + parts[1].try_cast("double") * 100 / F.nullif(parts[2].try_cast("double"), F.lit(0.0))
    return F.coalesce(F.when(parts[0] != "", F.round(mixed)), F.round(F.when(plain != "", plain).cast("double") * 100)).cast("int")


def maturity_year(name: Column) -> Column:
    year = F.regexp_extract(name, r"(?i)(?:due|maturing|of)\s+(?:\w+\s+)?(20[2-9]\d)", 1)
    bare = F.regexp_extract(name, r"\b(20[2-9]\d)\b", 1)
    return F.coalesce(F.when(year != "", year), F.when(bare != "", bare)).cast("int")


def instrument_type(name: Column) -> Column:
    n = F.lower(name)
    return reduce(lambda acc, tw: acc.when(n.rlike(tw[1]), tw[0]), TYPE_WORDS[1:], F.when(n.rlike(TYPE_WORDS[0][1]), TYPE_WORDS[0][0])).otherwise("senior_notes")


def clean_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, blocks end lines, the common entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def normal_path(path: Column) -> Column:
    """A request path with ids and tickers as placeholders."""
    p = F.regexp_replace(path, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")
    p = F.regexp_replace(p, r"/(companies|bonds)/[A-Z0-9.]{1,9}(?=/|$)", "/$1/{ticker}")
    return F.regexp_replace(p, r"/\d+(?=/|$)", "/{n}")


def latency_bucket(ms: Column) -> Column:
    return F.when(ms < 100, "<100ms").when(ms < 500, "100-500ms").when(ms < 1000, "500ms-1s").when(ms < 5000, "1-5s").otherwise(">5s")
