"""Facts and passages out of filing texts, by built-in regular expressions; rows stay independent."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import is_cusip, is_isin

#: What opens a section of each kind, tried in this order.
SECTIONS = (
    ("exhibit_21", r"(?im)^\s*(?:exhibit\s+21|subsidiaries of the registrant)\b"),
    ("debt_footnote", r"(?im)^\s*(?:note\s+\d+\W+)?(?:long[- ]term )?(?:debt|borrowings|notes payable)\s*$"),
    ("guarantor_note", r"(?im)^\s*(?:guarantor|supplemental guarantor)\s+(?:financial )?information\s*$"),
    ("covenants", r"(?im)^\s*(?:negative|financial|affirmative) covenants\s*$"),
    ("mda_liquidity", r"(?im)^\s*liquidity and capital resources\s*$"),
    ("indenture", r"(?i)\bthis indenture\b"),
    ("credit_agreement", r"(?i)\bcredit agreement\b.{0,200}\bdated as of\b"),
)
#: Words that name covenants.
COVENANT_WORDS = ("leverage ratio", "interest coverage", "fixed charge", "change of control", "limitation on liens", "restricted payments", "asset sales", "minimum liquidity")
#: Ratings as agencies print them.
RATING = r"(?:AAA|AA[+-]?|A[+-]?|BBB[+-]?|BB[+-]?|B[+-]?|CCC[+-]?|CC|C|Aaa|Aa[1-3]|A[1-3]|Baa[1-3]|Ba[1-3]|B[1-3]|Caa[1-3]|Ca)"


def section_type(text: Column) -> Column:
    """The first kind whose opening the text holds."""
    kind = F.when(text.rlike(SECTIONS[0][1]), SECTIONS[0][0])
    for name, pattern in SECTIONS[1:]:
        kind = kind.when(text.rlike(pattern), name)
    return kind


def sections(docs: DataFrame, key: str, text: str, most: int = 100_000) -> DataFrame:
    """(key, section_type, content): from each opening to the next blank-line-separated heading, at most `most` characters."""
    kinds = F.array(*[F.struct(F.lit(n).alias("section_type"), F.regexp_extract(text, rf"(?s)({p}.{{0,{most}}}?)(?=\n\s*\n[A-Z][A-Z ]{{6,}}\n|\z)", 1).alias("content")) for n, p in SECTIONS])
    return docs.select(key, F.explode(kinds).alias("s")).select(key, "s.*").where("content != ''")


def covenant_passages(text: Column, least: int = 50) -> Column:
    """Sentences that name a covenant, once each."""
    words = "|".join(COVENANT_WORDS)
    found = F.regexp_extract_all(text, F.lit(rf"(?i)([^.\n]*\b(?:{words})\b[^.\n]*\.)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda s: F.length(s) > least))


def cusips(text: Column) -> Column:
    """Valid CUSIPs that aren't a part of something longer."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Z0-9])([0-9A-Z]{9})(?![A-Z0-9])"), F.lit(1)), is_cusip))


def isins(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Z0-9])([A-Z]{2}[0-9A-Z]{9}\d)(?![A-Z0-9])"), F.lit(1)), is_isin))


def seniority(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("senior secured|first lien"), "senior_secured").when(t.rlike("subordinated|second lien"), "subordinated").when(t.rlike("senior unsecured|senior note"), "senior_unsecured")


def agency_ratings(text: Column) -> Column:
    """{sp, moodys}: the ratings that stand near the agencies' names."""
    near = lambda agency: F.nullif(F.regexp_extract(text, rf"(?:{agency})[^.\n]{{0,60}}?\b({RATING})(?![\w+-])", 1), F.lit(""))
    return F.struct(near("S&P|Standard & Poor").alias("sp"), near("Moody").alias("moodys"))


def scale(text: Column) -> Column:
    """Cents per reported unit, from the nearest statement of scale; 100 if none."""
    unit = F.lower(F.regexp_extract(text, r"(?i)\b(?:in|amounts? in)\s+(?:u\.?s\.?\s+)?(?:dollars in\s+)?(thousands|millions|billions)\b", 1))
    return F.when(unit == "thousands", 100_000).when(unit == "millions", 100_000_000).when(unit == "billions", 100_000_000_000).otherwise(100).cast("long")


def cut_at_sentence(text: Column, most: int) -> Column:
    """At most `most` characters, ended at a sentence if one ends in the last fifth."""
    head = F.substring(text, 1, most)
    ended = F.regexp_extract(head, rf"(?s)^(.{{{most * 4 // 5},}}[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(ended != "", ended).otherwise(head)


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """JSON as a model may print it: fences, comments and trailing commas go, open brackets close; null if
    it still isn't JSON."""

    def fix(raw: str | None) -> str | None:
        if raw is None:
            return None
        s = re.sub(r"^\s*```\w*|```\s*$", "", raw.strip())
        s = s[min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=0) :]
        s = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", s, flags=re.S)
        s = re.sub(r",\s*([}\]])", r"\1", s).rstrip().rstrip(",")
        opened: list[str] = []
        inside = False
        for i, c in enumerate(s):
            if c == '"' and (i == 0 or s[i - 1] != "\\"):
                inside = not inside
            elif not inside and c in "{[":
                opened.append("}" if c == "{" else "]")
            elif not inside and c in "}]" and opened:
                opened.pop()
        s += '"' * inside + "".join(reversed(opened))
        try:
            return json.dumps(json.loads(s), sort_keys=True)
        except ValueError:
            return None

    return text.map(fix)
