"""The screen: optional filters, field selection, sort, page and total over one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BadRequest(ValueError):
    """A parameter is out of range or unknown."""


class NotFound(LookupError):
    """A key that must exist doesn't."""


def comma_list(value: str | None, upper: bool = False) -> list[str]:
    items = [x.strip() for x in (value or "").split(",")]
    return [x.upper() if upper else x for x in items if x]


def percent_to_bps(value: float) -> int:
    """The binary product, truncated: 8.2 gives 819."""
    return int(value * 100)


def falsy_null(value: Column, divisor: int = 1) -> Column:
    """value / divisor, with 0 as null: the parity switch for callers that treat 0 as missing."""
    return F.when(value != 0, value / divisor)


@dataclass(frozen=True)
class Screen:
    """Lazy all through: each call adds to the plan. `keys` make every order total."""

    df: DataFrame
    keys: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    ordering: tuple[Column, ...] = ()
    columns: tuple[str, ...] = field(default=())

    def where(self, *conditions: Column | None) -> Screen:
        df = self.df
        for c in conditions:
            if c is not None:
                df = df.where(c)
        return replace(self, df=df)

    def is_in(self, column: str, values: Iterable[Any] | None) -> Screen:
        return self if values is None else self.where(F.col(column).isin(list(values)))

    def equals(self, **values: Any) -> Screen:
        return self.where(*[None if v is None else F.col(c) == v for c, v in values.items()])

    def between(self, column: str, low: Any = None, high: Any = None) -> Screen:
        return self.where(None if low is None else F.col(column) >= low, None if high is None else F.col(column) <= high)

    def near(self, column: str, value: int | None, tolerance: int) -> Screen:
        return self if value is None else self.between(column, value - tolerance, value + tolerance)

    def in_year(self, column: str, year: int | None) -> Screen:
        """A range of dates, so that the scan can skip row groups."""
        return self if year is None else self.between(column, F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31)))

    def contains(self, column: str, text: str | None) -> Screen:
        """Case-insensitive; % and _ in the text stay wildcards."""
        return self if text is None else self.where(F.col(column).ilike(f"%{text}%"))

    def present(self, column: str, wanted: bool | None) -> Screen:
        if wanted is None:
            return self
        return self.where(F.col(column).isNotNull() if wanted else F.col(column).isNull())

    def having(self, other: DataFrame, on: str, other_on: str, wanted: bool | None) -> Screen:
        """Rows with (or without) a partner; null keys of the partner never match."""
        if wanted is None:
            return self
        partner = other.where(F.col(other_on).isNotNull()).select(F.col(other_on).alias(on))
        return replace(self, df=self.df.join(partner, on, "left_semi" if wanted else "left_anti"))

    def fields(self, names: str | None) -> Screen:
        wanted = comma_list(names)
        known = self.allowed or tuple(self.df.columns)
        if unknown := sorted(set(wanted) - set(known)):
            raise BadRequest(f"unknown fields: {', '.join(unknown)}")
        return replace(self, columns=tuple(wanted) or tuple(known))

    def sort(self, by: str | None, known: Mapping[str, str] | None = None, default: str | None = None) -> Screen:
        """`-name` is descending, nulls last both ways; an unknown name falls back to the default."""
        name = (by or default or self.keys[0]).strip()
        column = (known or {c: c for c in self.df.columns}).get(name.lstrip("-"))
        if column is None:
            name = default or self.keys[0]
            column = (known or {}).get(name.lstrip("-"), name.lstrip("-"))
        first = F.col(column).desc_nulls_last() if name.startswith("-") else F.col(column).asc_nulls_last()
        return replace(self, ordering=(first, *[F.col(k).asc_nulls_last() for k in self.keys if k != column]))

    def page(self, limit: int = 50, offset: int = 0, most: int = 100) -> DataFrame:
        if not 1 <= limit <= most or offset < 0:
            raise BadRequest(f"limit must be 1..{most} and offset 0 or more")
        df = self.df.orderBy(*(self.ordering or tuple(F.col(k) for k in self.keys)))
        df = (df.offset(offset) if offset else df).limit(limit)
        return df.select(*self.columns) if self.columns else df

    def total(self) -> int:
        return self.df.select(*self.keys).distinct().count()

    def envelope(self, limit: int = 50, offset: int = 0, most: int = 100) -> dict[str, Any]:
        """The page as JSON-ready rows with its meta; the page is bounded by `most`."""
        rows = [r.asDict(recursive=True) for r in self.page(limit, offset, most).collect()]
        return {"data": rows, "meta": {"total": self.total(), "limit": limit, "offset": offset}}


def one(df: DataFrame, column: str, key: str) -> dict[str, Any]:
    """The row of an upper-cased unique key."""
    rows = df.where(F.upper(column) == key.upper()).take(1)
    if not rows:
        raise NotFound(f"{column} {key}")
    return rows[0].asDict(recursive=True)


def key_kind(key: str) -> str:
    """Nine characters are a CUSIP, all else an id."""
    return "cusip" if len(key) == 9 else "id"
