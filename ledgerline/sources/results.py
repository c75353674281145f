"""Results of extractions, JSON whose fields drift: read as VARIANT, each field by the names that it has had, never by a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field by its names, newest first, and its type. Names that results have used.
ENTITY = {"name": (("name", "entity_name"), "string"), "entity_type": (("entity_type", "type"), "string"), "parent": (("parent_name", "parent", "owners[0].parent_name"), "string"), "is_guarantor": (("is_guarantor", "guarantor"), "boolean")}
INSTRUMENT = {
    "name": (("name", "instrument_name"), "string"), "instrument_type": (("instrument_type", "type"), "string"), "issuer": (("issuer_name", "issuer"), "string"), "outstanding": (("outstanding", "outstanding_amount", "amount"), "decimal(20,2)"),
    "rate_bps": (("interest_rate", "rate_bps"), "int"), "maturity": (("maturity_date", "maturity"), "date"), "guarantors": (("guarantor_names", "guarantors"), "array<string>"),
}
LISTS = {"entities": ("entities", "company.entities"), "instruments": ("debt_instruments", "instruments", "debt")}


def read_field(v: Column, names: tuple[str, ...], kind: str) -> Column:
    """The first name that holds a value of the kind; what can't be one is null."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def parsed_results(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, result, fault): the text as VARIANT; `fault` says why a row has no lists: empty, not_json or not_object."""
    text, v = F.col("text"), F.col("result")
    # a text is parsed in a step of its own, once for all that is read of it
    read = df.select(key, F.col(json).alias("text")).select(key, "text", F.explode(F.array(F.try_parse_json("text"))).alias("result"))
    fault = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(v.isNull(), "not_json").when(~F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), "not_object")
    return read.select(key, "result", fault.alias("fault"))


def items(what: str, fields: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """array<struct<pos, fields>> of a list of the row's `result`. A list that is missing or no list has no items; an item that is no
    object, or without a name, is left out; a field that is missing or of a wrong type is null. Rows with a fault have an empty list."""
    there = F.when(F.col("fault").isNull(), read_field(F.col("result"), LISTS[what], "array<variant>"))
    item = lambda v, i: F.struct(i.alias("pos"), *[read_field(v, names, kind).alias(c) for c, (names, kind) in fields.items()])
    return F.filter(F.transform(F.coalesce(there, F.array().cast("array<variant>")), item), lambda x: x["name"].isNotNull())


def listed(results: DataFrame, key: str, what: str, fields: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """(key, pos, fields): a row for each item of a list, as in `items`."""
    return results.select(key, F.explode(items(what, fields)).alias("x")).select(key, "x.*")


def entities(results: DataFrame, key: str) -> DataFrame:
    return listed(results, key, "entities", ENTITY)


def instruments(results: DataFrame, key: str) -> DataFrame:
    return listed(results, key, "instruments", INSTRUMENT)


def load_summary(results: DataFrame, key: str) -> DataFrame:
    """(key, status, entities, instruments) of each row: loaded where anything was read, else the fault, else nothing_found."""
    # a count of names needs no other field
    named = lambda what, fields: F.size(items(what, {"name": fields["name"]})).cast("long")
    rows = results.select(key, "fault", named("entities", ENTITY).alias("entities"), named("instruments", INSTRUMENT).alias("instruments"))
    status = F.coalesce("fault", F.when(F.col("entities") + F.col("instruments") > 0, "loaded").otherwise("nothing_found"))
    return rows.select(key, status.alias("status"), "entities", "instruments")
