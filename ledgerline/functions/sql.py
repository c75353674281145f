"""The library's functions for those who write SQL: scalar functions as SQL text, which Catalyst inlines, and table functions in Python where rows
have to be made or carried along a partition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: name(parameters) -> type, and what it returns: the columns of functions/finance.py in SQL.
SCALARS = {
    "margin_pct(part DOUBLE, revenue DOUBLE) RETURNS DOUBLE": "CASE WHEN revenue > 0 AND part IS NOT NULL THEN bround(part / revenue * 100, 2) END",
    "safe_ratio(top DOUBLE, bottom DOUBLE) RETURNS DOUBLE": "CASE WHEN top <> 0 AND bottom <> 0 THEN bround(top / bottom, 2) END",
    "free_cash_flow(operating BIGINT, capex BIGINT) RETURNS BIGINT": "operating - abs(coalesce(capex, 0))",
    "price_of_yield(coupon DOUBLE, yld DOUBLE, years DOUBLE) RETURNS DOUBLE": """CASE WHEN abs(yld) < 1e-4 THEN 100 + coupon * 50 * (floor(years * 2) + 1)
        ELSE coupon * 50 * (1 - power(1 + yld / 2, -(floor(years * 2) + 1))) / nullif(yld / 2, 0) + 100 * power(1 + yld / 2, -(floor(years * 2) + 1)) END""",
    "spread_in_bps(yield_pct DOUBLE, treasury_pct DOUBLE) RETURNS INT": "CAST(signum(yield_pct - treasury_pct) * floor(abs((yield_pct - treasury_pct) * 100)) AS INT)",
    "rating_band(rating STRING) RETURNS STRING": "CASE regexp_extract(rating, '^[A-D]+', 0) WHEN 'AAA' THEN 'IG' WHEN 'AA' THEN 'IG' WHEN 'A' THEN 'IG' WHEN 'BBB' THEN 'IG' WHEN 'BB' THEN 'HY-BB' WHEN 'B' THEN 'HY-B' WHEN 'CCC' THEN 'HY-CCC' WHEN 'CC' THEN 'HY-CCC' WHEN 'C' THEN 'HY-CCC' ELSE 'NR' END",
}


@udtf(returnType="doc bigint, pos int, indent int, parent_pos int")
class ParentsByIndent:
    """SELECT * FROM parents_by_indent(TABLE(lines) PARTITION BY doc ORDER BY pos): lines (doc, pos, indent) with the nearest line above that
    has a smaller indent. A stack of open parents is all that a partition keeps."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, int]] = []

    def eval(self, row: Any) -> Iterator[tuple]:
        while self.stack and self.stack[-1][0] >= row["indent"]:
            self.stack.pop()
        yield row["doc"], row["pos"], row["indent"], self.stack[-1][1] if self.stack else None
        self.stack.append((row["indent"], row["pos"]))


@udtf(returnType="pos int, heading string, chunk string, tokens int")
class HeadingChunks:
    """heading_chunks(markdown): one row per `## ` section, the document's title in front."""

    def eval(self, markdown: str) -> Iterator[tuple]:
        text = markdown or ""
        title = re.search(r"(?m)^# (.+)$", text)
        for i, part in enumerate(re.split(r"(?m)^## ", text)[1:], 1):
            heading = part.split("\n", 1)[0].strip(" ")
            chunk = "\n".join(x for x in (title[1] if title else "", part.strip(" ")) if x)
            if heading:
                yield i, heading, chunk, len(chunk) // 4


@udtf(returnType="pos int, part string")
class KeywordWindows:
    """keyword_windows(text, word, before, after): texts around a keyword; a window begins behind the one before it."""

    def eval(self, text: str, word: str, before: int, after: int) -> Iterator[tuple]:
        for i, m in enumerate(re.finditer(rf"(?is).{{0,{before}}}\b{re.escape(word)}\b.{{0,{after}}}", text or "")):
            yield i, m[0]


TABLES = {"parents_by_indent": ParentsByIndent, "heading_chunks": HeadingChunks, "keyword_windows": KeywordWindows}


def register(spark: SparkSession) -> SparkSession:
    """The functions, known to this session's SQL."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return spark
