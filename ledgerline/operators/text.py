"""Full-text search over documents, and what the texts of filings say."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words without meaning for a search.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stem(word: Column) -> Column:
    """A light English stem: plural, -ing, -ed, -ly go. Approximate by design."""
    w = F.regexp_replace(word, r"(?<=[a-z]{3})(?:sses)$", "ss")
    w = F.regexp_replace(w, r"(?<=[a-z]{2})ies$", "y")
    w = F.regexp_replace(w, r"(?<=[a-z]{2}[^su])s$", "")
    w = F.regexp_replace(w, r"(?<=[a-z]{3})(?:ing|ed|ly)$", "")
    return F.regexp_replace(w, r"(?<=[a-z]{3})e$", "")


def terms(text: Column) -> Column:
    return F.transform(F.filter(tokens(text), lambda w: ~w.isin(*STOP_WORDS)), stem)


def matches_all(text: Column, query: Column) -> Column:
    """All terms of the query occur; a query of stop words alone matches nothing."""
    q = F.array_distinct(terms(query))
    return (F.size(q) > 0) & (F.size(F.array_except(q, terms(text))) == 0)


def inverted_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, positions): what a search reads instead of the texts."""
    pos = docs.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term"))
    return pos.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct stems of a query's words."""
    return spark.range(1).select(F.array_sort(F.array_distinct(terms(F.lit(query)))).alias("t")).first()["t"]


def ranked(hits: DataFrame, n: int, key: str) -> DataFrame:
    """(key, score) of rows (term, key, tf, first) for documents that hold all n terms, by term frequency and
    the distance between the terms' first places."""
    found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p("tf")).alias("tf"), F.min("first").alias("first"), F.max("first").alias("last"))
    return found.where((F.col("n") == n) & (F.lit(n) > 0)).select(key, F.round(F.col("tf") / (1 + F.log1p(F.col("last") - F.col("first"))), 4).alias("score"))


def search(index: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """(key, score) from an inverted index; kept by term, only the lists of the query's terms are read."""
    wanted = query_terms(index.sparkSession, query)
    hits = index.where(F.col("term").isin(wanted)).select("term", key, "tf", F.element_at("positions", 1).alias("first"))
    return ranked(hits, len(wanted), key)


def search_texts(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same from the texts. Each row looks for its own hits and only those are stemmed: a stem but its last
    letter begins each of its words, so other words, and texts that lack one, are out by a plain comparison."""
    wanted = query_terms(docs.sparkSession, query)
    begin = [w[:-1] or w for w in wanted]
    some = docs.select(key, F.lower(text).alias("low"))
    for b in begin:
        some = some.where(F.contains("low", F.lit(b)))
    like = lambda w: reduce(lambda x, y: x | y, [F.startswith(w, F.lit(b)) for b in begin], F.lit(False))
    words = some.select(key, F.posexplode(F.filter(tokens(F.col("low")), lambda w: ~w.isin(*STOP_WORDS))).alias("pos", "word")).where(like(F.col("word")))
    found = words.withColumn("term", stem(F.col("word"))).where(F.col("term").isin(wanted))
    return ranked(found.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first")), len(wanted), key)


def cover_density(docs: DataFrame, query: str, key: str, weights: Mapping[str, float]) -> DataFrame:
    """(key, score) of the documents that hold all terms of the query, in any of the weighted columns.

    A cover is a shortest stretch with all terms. It counts the harmonic mean of its hits' weights, divided by one
    more than the words in it that are no hits; the score is the sum over covers, to 4 places. Words are numbered
    through the columns in the order given, words without meaning included. Null columns have no words."""
    wanted = query_terms(docs.sparkSession, query)
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    like = lambda w: reduce(lambda x, y: x | y, [F.startswith(w, F.lit(t[:-1] or t)) for t in wanted])

    def places(words: Column, behind: Column, weight: float) -> Column:
        return F.transform(words, lambda w, i: F.struct((i + behind).alias("pos"), w.alias("word"), F.lit(1 / weight).alias("inverse")))

    behind: Column = F.lit(0)
    parts = []
    for column, weight in weights.items():
        words = F.coalesce(tokens(F.col(column)), F.array().cast("array<string>"))
        parts.append(places(words, behind, weight))
        behind = behind + F.size(words)
    rows = docs.select(key, F.explode(F.filter(F.concat(*parts), lambda x: like(x["word"]) & ~x["word"].isin(*STOP_WORDS))).alias("hit")).select(key, "hit.*")
    rows = rows.withColumn("term", stem(F.col("word"))).where(F.col("term").isin(wanted))
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("sum", F.sum("inverse").over(upto))
    last = [F.last(F.when(F.col("term") == t, F.struct("pos", "nth", (F.col("sum") - F.col("inverse")).alias("before"))), ignorenulls=True).over(upto) for t in wanted]
    rows = rows.withColumn("ends", F.array(*last)).where(~F.exists("ends", lambda x: x.isNull())).withColumn("start", F.array_min("ends"))
    covers = rows.withColumn("earlier", F.lag("start.pos").over(order)).where(F.col("earlier").isNull() | (F.col("start.pos") > F.col("earlier")))
    hits = F.col("nth") - F.col("start.nth") + 1
    noise = F.col("pos") - F.col("start.pos") - (hits - 1)
    return covers.groupBy(key).agg(F.round(F.sum(hits / (F.col("sum") - F.col("start.before")) / (1 + noise)), 4).alias("score"))


def snippet(text: Column, query: Column, words: int = 50) -> Column:
    """`words` words around the first match, the matching ones in <b>."""
    all_words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    q = F.array_distinct(terms(query))
    is_hit = lambda w: F.exists(terms(w), lambda t: F.array_contains(q, t))
    first = F.array_position(F.transform(all_words, is_hit), True).cast("int")
    part = F.slice(all_words, F.greatest(F.lit(1), first - words // 3), F.lit(words))
    return F.array_join(F.transform(part, lambda w: F.when(is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")


def keyword_windows(text: Column, word: str, before: int, after: int, most: int) -> Column:
    """Texts around a keyword; a window begins behind the one before it."""
    pattern = rf"(?is)(.{{0,{before}}}\b{word}\b.{{0,{after}}})"
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, most)


def coupons(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2}\.\d{1,4})\s*%"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_distinct(F.filter(found, lambda x: (x > 0) & (x < 25)))


def years(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x > 2000) & (x < 2100)))


def without_party(text: Column) -> Column:
    """The text without the names, of 98 letters at most, between which an agreement is said to be: the number of Acme Holdings 2015 is no year."""
    return F.regexp_replace(text, r"between\s+[A-Z][A-Za-z0-9\s,.&']{1,98}?(?=\s*,?\s*(?:as\s+(?:Issuer|Company|Borrower)|and\s))", " ")


def amounts_cents(text: Column) -> Column:
    """Dollar amounts with their unit, in cents."""
    raw = F.regexp_extract_all(text, F.lit(r"(?i)(\$\s?\d[\d,]*(?:\.\d+)?\s*(?:billion|million|thousand)?)"), F.lit(1))

    def cents(x: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(x, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").cast("double")
        unit = F.when(x.rlike("(?i)billion"), 1e11).when(x.rlike("(?i)million"), 1e8).when(x.rlike("(?i)thousand"), 1e5).otherwise(100.0)
        return F.round(number * unit).cast("long")

    return F.array_distinct(F.transform(raw, cents))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest by cosine: each task keeps its own k, so only those meet."""
    if not query or math.isclose(sum(x * x for x in query), 0.0):
        raise ValueError("the query vector is empty or zero")
    score = cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def markdown_chunks(docs: DataFrame, key: str, text: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, heading, chunk, tokens): one row per `## ` section, the document's title in front."""
    title = F.regexp_extract(F.col(text), r"(?m)^# (.+)$", 1)
    parts = docs.select(key, title.alias("title"), F.posexplode(F.split(text, r"(?m)^## ")).alias("pos", "part")).where("pos > 0")
    heading = F.trim(F.substring_index("part", "\n", 1))
    chunk = F.concat_ws("\n", F.nullif("title", F.lit("")), F.trim("part"))
    return parts.select(key, "pos", heading.alias("heading"), chunk.alias("chunk"), F.floor(F.length(chunk) / 4).alias("tokens")).where(~F.col("heading").isin(*skip, ""))
