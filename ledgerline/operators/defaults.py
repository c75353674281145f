"""What defaults in consequence: typed links between instruments, and all that follows along them."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import written
from .graph import closure

#: Kinds of links along which a default spreads, and the kind that only ranks.
SPREADING = ("cross_default", "cross_acceleration")
RANKING = "pari_passu"
#: Edges of a company up to which its ways are found in one row; larger companies, and those linked with others, take the closure.
ROW = 512


def default_edges(links: DataFrame, instruments: DataFrame) -> DataFrame:
    """(src, dst, weight): a default of src is one of dst. links: source_id, target_id, relationship, threshold, is_bilateral: the
    source defaults with its target, and with a null target when any other debt of its company above the threshold (null: any) does;
    bilateral links hold both ways. Only active instruments count, and only SPREADING kinds.

    Debt above a threshold meets at one node of its company and threshold, to which it has an edge of weight 1 and from
    which those that watch it have one of weight 0: instruments times thresholds, not pairs of instruments."""
    kind = F.col("relationship").isin(*SPREADING)
    live = instruments.where("is_active").select("id", "company_id", "outstanding")
    node = lambda c: F.concat(F.lit("i:"), F.col(c).cast("string"))
    used = links.where(kind).select("source_id", "target_id", "threshold", "is_bilateral").join(live.select(F.col("id").alias("source_id"), "company_id"), "source_id")
    named = used.join(live.select(F.col("id").alias("target_id")), "target_id").select(node("target_id").alias("src"), node("source_id").alias("dst"), "is_bilateral")
    back = named.where("is_bilateral").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    open_ended = used.where("target_id is null and company_id is not null").withColumn("threshold", F.coalesce("threshold", F.lit(0)))
    pool = F.concat(F.lit("p:"), F.col("company_id").cast("string"), F.lit(":"), F.col("threshold").cast("string"))
    watch = open_ended.select(pool.alias("src"), node("source_id").alias("dst")).distinct()
    pools = open_ended.select("company_id", "threshold").distinct()
    large = live.join(pools, "company_id").where(F.col("outstanding") > F.col("threshold")).select(node("id").alias("src"), pool.alias("dst"))
    one, none = F.lit(1).alias("weight"), F.lit(0).alias("weight")
    direct = named.select("src", "dst").unionByName(back).distinct()
    return direct.select("src", "dst", one).unionByName(large.select("src", "dst", one)).unionByName(watch.select("src", "dst", none))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ways_within(edges: pd.Series) -> pd.Series:
    """The shortest ways (src, dst, steps) along a company's edges (src, dst, weight), number after number; negative nodes are gone
    through and no ends."""

    def ways(numbers: list[int]) -> list[int]:
        flat = list(map(int, numbers))
        near: dict[int, list[tuple[int, int]]] = {}
        for src, dst, weight in zip(flat[::3], flat[1::3], flat[2::3], strict=True):
            near.setdefault(src, []).append((dst, weight))
        out: list[int] = []
        for start in (s for s in near if s > 0):
            best, todo = {start: 0}, [(0, start)]
            while todo:
                d, at = heapq.heappop(todo)
                if d == best[at]:
                    for to, w in near.get(at, ()):
                        if d + w < best.get(to, 1 << 30):
                            best[to] = d + w
                            heapq.heappush(todo, (d + w, to))
            for to, d in best.items():
                if to > 0 and to != start:
                    out += (start, to, d)
        return out

    return edges.map(ways)


def default_reach(links: DataFrame, instruments: DataFrame) -> DataFrame:
    """(id, reached, steps): every instrument that defaults if one does, by its fewest steps. A company of up to ROW edges that none leads
    into or out of is one row, and only its edges move; all others take the closure."""
    edges = written(default_edges(links, instruments), "default-edges")
    live = instruments.where("is_active").select(F.concat(F.lit("i:"), F.col("id").cast("string")).alias("node"), F.col("company_id").cast("string").alias("company"))
    own = lambda c: F.when(F.col(c).startswith("p:"), F.substring_index(F.substring_index(c, ":", 2), ":", -1))
    side = lambda rows, c: rows.join(live.withColumnsRenamed({"node": c, "company": f"{c}_at"}), c, "left").withColumn(f"{c}_at", F.coalesce(f"{c}_at", own(c), F.lit("?")))
    placed = written(side(side(edges, "src"), "dst"), "default-edges")
    crossed = placed.where("src_at <> dst_at").select(F.explode(F.array("src_at", "dst_at")).alias("at"))
    large = placed.groupBy(F.col("src_at").alias("at")).count().where(F.col("count") > ROW).select("at")
    apart = crossed.unionByName(large).unionByName(placed.sparkSession.createDataFrame([("?",)], "at string")).distinct()
    outer = closure(placed.join(apart, placed.src_at == apart["at"], "left_semi").select("src", "dst", "weight")).where("src like 'i:%' and dst like 'i:%'").select("src", "dst", F.col("distance").alias("steps"))
    rows = placed.join(apart, placed.src_at == apart["at"], "left_anti").groupBy("src_at").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("edges"))
    rows = rows.select("edges", F.array_distinct(F.concat(F.transform("edges", lambda e: e["src"]), F.transform("edges", lambda e: e["dst"]))).alias("nodes"))
    number = lambda n: (F.array_position("nodes", n) * F.when(n.startswith("i:"), 1).otherwise(-1)).cast("int")
    rows = rows.select("nodes", ways_within(F.flatten(F.transform("edges", lambda e: F.array(number(e["src"]), number(e["dst"]), e["weight"].cast("int"))))).alias("ways"))
    at = lambda k: F.get("ways", k)
    way = lambda k: F.struct(F.get("nodes", at(k) - 1).alias("src"), F.get("nodes", at(k + 1) - 1).alias("dst"), at(k + 2).cast("long").alias("steps"))
    inner = rows.where(F.size("ways") > 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("ways") - 3, F.lit(3)), way)).alias("w")).select("w.*")
    kind = dict(instruments.dtypes)["id"]
    bare = lambda c: F.substring(c, 3, 1 << 20).cast(kind)
    return outer.unionByName(inner).select(bare("src").alias("id"), bare("dst").alias("reached"), "steps")


def default_exposure(links: DataFrame, instruments: DataFrame) -> DataFrame:
    """(id, n, amount, steps) of active instruments: how many others default with one, their debt, and the steps to the last."""
    live = instruments.where("is_active").select("id", "outstanding")
    reach = default_reach(links, instruments).join(live.withColumnRenamed("id", "reached"), "reached")
    sums = reach.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("outstanding"), F.lit(0)).alias("amount"), F.max("steps").alias("steps"))
    return live.select("id").join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0)).cast("long").alias("amount"), F.coalesce("steps", F.lit(0)).alias("steps"))
