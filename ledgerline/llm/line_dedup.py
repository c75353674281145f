"""Line de-duplication with keep bitmaps, in DataFrame operations only.

Long lines travel as 128-bit hashes of their keys with document and position, never as text. Counts
combined before each shuffle find the keys of many documents; the rows of those keys are range-partitioned
by hash and sorted by document, last first, and position. The first row of a key in that order names the
document that keeps the line; the rows of other documents that stream by behind it clear bits in
per-document keep bitmaps of 64-bit words. Words without a dropped line are left out, so a bitmap is as
large as what is dropped. The text is touched once, when a caller applies the bitmaps.

A hot key is safe: its rows are counted by (key, document) first and combined before they meet by key. Keys with
more than PART rows and 1 / HOT_KEYS of all rows, HOT_KEYS of them at most by that very bound, are broadcast to where their rows
lie; the rows of all other keys are joined by key. A key's documents fall by hash into parts of about PART rows,
each sorted and streamed apart; the few rows of each part's first document then meet the first of all parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The characters stripped at both ends of a line.
STRIP = " \t\n\x0b\x0c\r"
#: Documents of a key that are sorted and streamed together.
PART = 1024
#: Keys that are hot at most, so that a broadcast of them is bounded.
HOT_KEYS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at the ends, A-Z lower-cased; lower() does that for ASCII lines."""
    key = F.btrim(line, F.lit(STRIP))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def row_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text hash): repeated ids with other texts stay apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("t", F.xxhash64("text"))


def joined_by_key(hashed: DataFrame, often: DataFrame, most: int) -> DataFrame:
    """hashed with the columns of its key in often. Keys of more than `most` lines don't go through the shuffle of the rest."""
    key = ["h1", "h2"]
    hot, cold = often.where(F.col("n_lines") > most), often.where(F.col("n_lines") <= most)
    if hot.isEmpty():
        return hashed.join(often, key)
    rest = hashed.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return hashed.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, t, bits): for documents that lose lines, 64-bit words by index, a bit for each kept line;
    words that lose nothing are left out.

    Rows without a doc_id take no part: no line of theirs is counted or dropped.
    """
    rows = row_key(docs).where(F.col("doc_id").isNotNull())
    lines = rows.select("doc_id", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashed = written(keyed.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-hashes")
    often = written(
        hashed.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("lines").alias("n_lines")).where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "n_lines", F.ceil(F.col("n_docs") / PART).alias("parts")),
        "line-keys",
    )
    run = ["h1", "h2", "part"]
    shared = joined_by_key(hashed, often, max(PART, hashed.count() // HOT_KEYS)).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    ordered = shared.repartitionByRange(*run).sortWithinPartitions(*run, F.desc("doc_id"), "pos")
    first = F.first("doc_id").over(Window.partitionBy(*run).orderBy(F.desc("doc_id"), "pos"))
    # rows behind the first document, and of keys in parts the first document of each part
    behind = ordered.withColumn("head", F.col("doc_id") == first).where(~F.col("head") | (F.col("parts") > 1))
    behind = written(behind.select("h1", "h2", "doc_id", "t", "pos", "head"), "line-drops")
    heads = behind.where("head")
    keepers = heads.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"))
    gone = behind.where("not head").select("doc_id", "t", "pos")
    gone = gone.unionByName(heads.join(keepers, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "t", "pos"))
    words = gone.groupBy("doc_id", "t", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))"))).alias("bits"))
    return words.groupBy("doc_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def deduplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: doc_id, kept text, n_lines, n_dropped.

    Null and empty texts are one empty line. Rows with the same doc_id count as one document, and
    identical rows lose the same lines; other columns are not read; an empty table gives no rows.
    A document that loses all lines keeps an empty text.
    """
    bits = keep_bitmaps(docs, min_chars, min_docs)
    # bitmaps are a small part of a partition's text: hashing them spares sorting the texts
    rows = row_key(docs).join(bits.hint("shuffle_hash"), ["doc_id", "t"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.expr("filter(split(text, '\n', -1), (l, i) -> (shiftright(coalesce(try_element_at(bits, shiftright(i, 6)), -1L), i & 63) & 1L) = 1L)")
    return rows.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("bits").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.expr("coalesce(aggregate(map_values(bits), 0L, (n, w) -> n + 64 - bit_count(w)), 0L)").cast("long").alias("n_dropped"),
    )


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), often as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
), marked as (
  select k.doc_id, k.pos, k.line, o.key is not null and k.doc_id <> o.keeper as gone
  from keyed k left join often o on k.key = o.key
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
