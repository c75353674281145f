"""Sources: tables, wide curve files, columnar-array JSON, filing dictionaries, LEI files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column heads of the daily curve file and the tenors they stand for.
CURVE_TENORS = {"1 Mo": "1M", "3 Mo": "3M", "6 Mo": "6M", "1 Yr": "1Y", "2 Yr": "2Y", "3 Yr": "3Y", "5 Yr": "5Y", "7 Yr": "7Y", "10 Yr": "10Y", "20 Yr": "20Y", "30 Yr": "30Y"}


def curve_rows(wide: DataFrame) -> DataFrame:
    """(yield_date, benchmark, yield_pct) from a Date column and a column per tenor; blanks, N/A and bad
    dates go, and so do columns that aren't known tenors."""
    heads = [c for c in wide.columns if c.strip() in CURVE_TENORS]
    pairs = F.array(*[F.struct(F.lit(CURVE_TENORS[c.strip()]).alias("benchmark"), F.col(f"`{c}`").cast("string").alias("raw")) for c in heads])
    long = wide.select(F.try_to_date(F.col("Date").cast("string"), "MM/dd/yyyy").alias("yield_date"), F.explode(pairs).alias("p"))
    return long.select("yield_date", "p.benchmark", F.trim("p.raw").try_cast("decimal(6,4)").alias("yield_pct")).where("yield_date is not null and yield_pct is not null")


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    return curve_rows(spark.read.option("header", True).csv(path))


def latest_curve(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("benchmark").agg(F.max_by(F.struct("yield_date", "yield_pct"), "yield_date").alias("x"))
    return last.select("benchmark", "x.*")


def candle_rows(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, day, close, volume) from JSON of parallel arrays t, c, v; rows without a close go."""
    parsed = F.from_json(json, "struct<t:array<long>,c:array<double>,v:array<double>>")
    rows = df.select(key, parsed.alias("p")).select(key, F.explode(F.arrays_zip("p.t", "p.c", "p.v")).alias("x"))
    return rows.select(key, F.to_date(F.timestamp_seconds("x.t")).alias("day"), F.col("x.c").alias("close"), F.col("x.v").alias("volume")).where("close is not null")


def curve_maps(df: DataFrame, json: str) -> DataFrame:
    """(yield_date, benchmark, yield_pct) from JSON lists of {date, rates: {tenor: value}}."""
    parsed = F.from_json(json, "array<struct<date:string,rates:map<string,double>>>")
    rows = df.select(F.explode(parsed).alias("x")).select(F.try_to_date("x.date").alias("yield_date"), F.explode("x.rates").alias("benchmark", "yield_pct"))
    return rows.where("yield_date is not null and yield_pct is not null")


def filing_rows(df: DataFrame, key: str, json: str, forms: tuple[str, ...], since: str) -> DataFrame:
    """(key, form, filed, accession) from parallel arrays; forms and dates are filtered, bad dates go."""
    parsed = F.from_json(json, "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>>")
    rows = df.select(key, parsed.alias("p")).select(key, F.explode(F.arrays_zip("p.form", "p.filingDate", "p.accessionNumber")).alias("x"))
    rows = rows.select(key, F.col("x.form").alias("form"), F.try_to_date("x.filingDate").alias("filed"), F.col("x.accessionNumber").alias("accession"))
    return rows.where(F.col("form").isin(*forms) & (F.col("filed") >= F.lit(since).cast("date")))


def keyed_filings(df: DataFrame, key: str, text: str, least: int = 1000) -> DataFrame:
    """(key, doc_type, filed, exhibit, text) from keys like `10-K_2024-02-01_ex21`; short texts go."""
    k = F.col(key)
    filed = F.regexp_extract(k, r"_(\d{4}-\d{2}-\d{2})", 1)
    exhibit = F.regexp_extract(k, r"_\d{4}-\d{2}-\d{2}_(.+)$", 1)
    return df.where(F.length(text) >= least).select(key, F.substring_index(k, "_", 1).alias("doc_type"), F.try_to_date(filed).alias("filed"), F.nullif(exhibit, F.lit("")).alias("exhibit"), text)


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, indent, cells): the rows of the tables of a page; the indent is the number of empty cells
    before the first full one."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cell = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"(&nbsp;|\s)+", " ")))
    rows = rows.select(key, "pos", cell.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    first = F.array_position(F.transform("cells", lambda c: c != ""), True) - 1
    return rows.select(key, "pos", first.cast("int").alias("indent"), F.filter("cells", lambda c: c != "").alias("cells"))


def lei_index(df: DataFrame, name: str, lei: str) -> DataFrame:
    from ..functions.names import bare_name

    rows = df.where(F.col(lei).isNotNull() & (F.trim(name) != ""))
    return rows.groupBy(bare_name(F.col(name)).alias("bare_name")).agg(F.sort_array(F.collect_set(lei)).alias("leis"))


def lei_parents(df: DataFrame) -> DataFrame:
    """(child, direct, ultimate) from active relationships (child, parent, kind, status, updated): the newest counts."""
    rows = df.where("status = 'ACTIVE'")
    newest = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("parent")), F.when(F.col("kind") == kind, F.col("updated")))
    return rows.groupBy("child").agg(newest("IS_DIRECTLY_CONSOLIDATED_BY").alias("direct"), newest("IS_ULTIMATELY_CONSOLIDATED_BY").alias("ultimate"))


def years_axis(spark: SparkSession, first: int, count: int) -> DataFrame:
    return spark.range(first, first + count).toDF("year")
