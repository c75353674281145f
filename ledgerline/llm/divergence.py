"""Source divergence audit: which terms set a source apart, and how far sources of a language are apart.

Document frequencies of (language, term) first go into a count-min sketch: each task fills its own cells,
Spark sums them by cell, and what remains is one bit a cell, at most DEPTH * width of them: whether the
cell reaches `min_docs`. A sketch never underestimates, so a term with a bit missing can't be in enough
documents and is dropped inside the task that reads it. Survivors are counted exactly by language,
source and term, combined in the task before the shuffle.

The distance of two sources sums over all kept terms, yet only terms that both have need to meet: a term
that one of them has not takes that source's base share, which depends on the source alone. So
    sum |p - q| = both + alone(s, t) + alone(t, s) + (V - n_s - n_t) * |b_s - b_t|,
where alone(s, t) runs over the counts that occur in s, and `both` corrects the terms of both. Sources
fall into blocks, so a term that every source has is met block by block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTERS, text_slices, written

DEPTH = 3
#: Cells of a row of the sketch: a power of two, by the rows of the corpus and within these bounds.
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 24
#: Terms that a task counts before it hands them on.
HELD = 300_000
#: Sources of a language that meet in one block, and parts of a language in joins by language.
BLOCK, PARTS = 64, 32


def cells_of(lang: bytes, terms: list[bytes], width: int) -> np.ndarray:
    """The cells of terms of a language, a column for each row of the sketch."""
    seed = xxhash.xxh3_64_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return np.stack([((low + np.uint64(d) * high) & np.uint64(width - 1)).astype(np.int64) + d * width for d in range(DEPTH)], axis=1)


def filled(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(cell, n): each task's cells, up to `most`: more than that tells nothing new."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(DEPTH * width, np.int32)
        held: defaultdict[bytes, Counter] = defaultdict(Counter)

        def flush() -> None:
            for lang, counts in held.items():
                at = cells_of(lang, list(counts), width)
                n = np.fromiter(counts.values(), np.int64, len(counts))
                for d in range(DEPTH):
                    np.add.at(cells, at[:, d], np.minimum(n, most))
            np.minimum(cells, most, out=cells)
            held.clear()

        for batch in batches:
            for part, texts in text_slices(batch):
                for lang, text in zip(part.column("lang").cast(pa.binary()).to_pylist(), texts, strict=True):
                    held[lang].update(set(text.translate(LETTERS).split()))
                if sum(map(len, held.values())) > HELD:
                    flush()
        flush()
        found = np.flatnonzero(cells)
        for i in range(0, len(found), 1 << 16):
            at = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at].astype(np.int64))], names=["cell", "n"])

    return rows.select("lang", "text").mapInArrow(work, "cell long, n long")


def possible(rows: DataFrame, width: int, min_docs: int) -> np.ndarray:
    """The merged sketch as bits: may a cell's terms be in min_docs documents? DEPTH * width bits, whatever the corpus."""
    cells = filled(rows, width, min_docs).groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(DEPTH * width // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint64)


def surviving(bits: np.ndarray, lang: bytes, terms: list[bytes], width: int) -> np.ndarray:
    at = cells_of(lang, terms, width)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)


def counted(rows: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """(lang, source, term, docs, n): exact counts of the terms that the sketch lets through, and a row without
    a term for each group."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: defaultdict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        uses: defaultdict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        groups: Counter = Counter()

        def out(group: tuple[bytes, bytes], terms: list, d: list[int], n: list[int]) -> pa.RecordBatch:
            names = [pa.array([x] * len(terms), pa.binary()).cast(pa.string()) for x in group]
            return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            for group, found in docs.items():
                terms = list(found)
                keep = np.flatnonzero(surviving(shared.value, group[0], terms, width)).tolist() if terms else []
                terms = [terms[i] for i in keep]
                yield out(group, terms, [found[t] for t in terms], [uses[group][t] for t in terms])
            docs.clear()
            uses.clear()

        for batch in batches:
            for part, texts in text_slices(batch):
                names = (part.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source"))
                for lang, source, text in zip(*names, texts, strict=True):
                    terms = text.translate(LETTERS).split()
                    groups[lang, source] += 1
                    docs[lang, source].update(set(terms))
                    uses[lang, source].update(terms)
                if sum(map(len, docs.values())) > HELD:
                    yield from flush()
        yield from flush()
        for group, n in groups.items():
            yield out(group, [None], [n], [0])

    return rows.mapInArrow(work, "lang string, source string, term string, docs long, n long").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (n + 5) / (total + 5 * terms)) without overflow; null where there are no terms."""
    top = f"cast({n} + 5 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))"
    return F.expr(f"1 + ({top}) div nullif(cast({total} + 5 * {terms} as decimal(20, 0)), 0)")


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) in two parts: `pair`, the summed difference of a source to each
    other source of its language, and `term`, the `top` terms that a source uses more than its language.

    Null text, lang and source are read as ''; a document without terms makes its group occur; repeated rows
    count each; other columns are not read; an empty table gives no rows. `width` is the row length of the
    sketch, a power of two; without it, it follows the number of rows. Results don't depend on it.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    rows = docs.select(*[x.alias(c) for c, x in text.items()])
    if width is None:
        width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (16 * docs.count()).bit_length()))
    counts = written(counted(rows, possible(rows, width, min_docs), width), "term-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    terms = written(terms.drop("docs"), "kept-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    cells = written(counts.where("n > 0").join(terms, ["lang", "term"]), "group-terms")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(groups.withColumn("base", F.coalesce(share("0L", "total", "v"), F.lit(0))), "groups")
    shares = cells.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")})
    return term_part(shares, top).unionByName(pair_part(shares, cells, groups))


def term_part(shares: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def pair_part(shares: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    at = F.pmod(F.xxhash64("source"), "blocks")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = shares.select("lang", "source", "term", "p", "base").join(blocks, "lang").withColumn("block", at)
    one = dealt.select("lang", "term", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"), F.col("source").alias("s"), F.col("p").alias("ps"), F.col("base").alias("bs"))
    two = dealt.select("lang", "term", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("lo"), F.col("block").alias("hi"), F.col("source").alias("t"), F.col("p").alias("pt"), F.col("base").alias("bt"))
    met = one.join(two, ["lang", "term", "lo", "hi"]).where("lo < hi or s < t")
    change = F.expr("abs(ps - pt) - abs(ps - bt) - abs(pt - bs) + abs(bs - bt)")
    both = met.groupBy("lang", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum(change).alias("w"))
    # what each source's own terms, by their count, and the terms of neither make against each other source
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("slot")
    others = groups.select("lang", F.col("source").alias("t"), F.col("base").alias("bt"), F.col("n_terms").alias("nt"), part)
    own = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    own = own.join(groups.select("lang", "source", "total", "v", "base"), ["lang", "source"]).select("lang", F.col("source").alias("s"), share("n", "total", "v").alias("p"), "times", F.pmod(F.xxhash64("source", "n"), F.lit(PARTS)).alias("slot"))
    alone = own.join(others, ["lang", "slot"]).where("s <> t").select("lang", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), F.expr("times * abs(p - bt)").alias("w"))
    sided = groups.select("lang", F.col("source").alias("s"), "v", F.col("base").alias("bs"), F.col("n_terms").alias("ns"), F.pmod(F.xxhash64("source"), F.lit(PARTS)).alias("slot"))
    neither = sided.join(others, ["lang", "slot"]).where("s < t").select("lang", F.col("s").alias("x"), F.col("t").alias("y"), F.expr("(v - ns - nt) * abs(bs - bt)").alias("w"))
    sums = alone.unionByName(neither).unionByName(both.select("lang", F.col("s").alias("x"), F.col("t").alias("y"), "w")).groupBy("lang", "x", "y").agg(F.sum("w").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("way")
    rows = sums.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), words as (
  select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
), kept as (
  select lang, term, count(*) as n from words group by all having count(distinct id) >= 30
), groups as (
  select distinct lang, source from d
), cells as (
  select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n
  from groups g join kept k on g.lang = k.lang
  left join (select lang, source, term, count(*) as n from words group by all) c on c.lang = g.lang and c.source = g.source and c.term = k.term
), shares as (
  select lang, source, term, n,
         1 + (1000000000 * (n + 5)) // (sum(n) over g + 5 * count(*) over g) as p,
         1 + (1000000000 * (lang_n + 5)) // (sum(lang_n) over g + 5 * count(*) over g) as q
  from cells window g as (partition by lang, source)
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(w.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source as s, y.source as t, sum(abs(x.p - y.p)) as value
             from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) w
    on w.lang = a.lang and w.s = a.source and w.t = b.source
), ranked as (
  select lang, source, 'pair' as part, item, cast(value as bigint) as value,
         cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pairs
  union all
  select lang, source, 'term', term, cast(p - q as bigint),
         cast(row_number() over (partition by lang, source order by p - q desc, term) as int) from shares where n > 0 and p > q
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
