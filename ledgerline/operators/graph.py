"""Traversal of parent and edge tables, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import written
from .filings import parents_of_indents

MAX_DEPTH = 10


def reach(edges: DataFrame, starts: DataFrame, depth: int, keep: Column | None = None) -> DataFrame:
    """(id, depth) of what the starts reach along (src, dst) edges, each node once at its least depth,
    starts not included. `keep` is a condition on the edge's columns: what fails it is not reached and
    not gone through. Each level is kept in the shared folder, so plans don't grow; anti joins stop cycles."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1..{MAX_DEPTH}")
    usable = edges if keep is None else edges.where(keep)
    usable = usable.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = frontier = written(starts.select(F.col(starts.columns[0]).alias("id"), F.lit(0).alias("depth")).distinct(), "frontier")
    for level in range(1, depth + 1):
        near = frontier.select(F.col("id").alias("src"))
        found = usable.join(near, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = written(found.withColumn("depth", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def descendants(nodes: DataFrame, starts: DataFrame, depth: int, keep: Column | None = None) -> DataFrame:
    """nodes (id, parent_id, ...): children of the starts, down to `depth`; `keep` is on the child's columns."""
    edges = nodes.withColumns({"src": F.col("parent_id"), "dst": F.col("id")})
    return reach(edges, starts, depth, keep)


def ancestors(nodes: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    return reach(nodes.select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), starts, depth)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, distance) of all that each node reaches along (src, dst) edges, or (src, dst, weight) ones, by its shortest way;
    a node on a ring doesn't reach itself. Ways double in length each round until none is new or shorter, so a chain takes as
    many rounds as its length has bits. Weights are not negative; rounds are kept in the shared folder."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    best = lambda rows: rows.where("src <> dst").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    ways = written(best(edges.select("src", "dst", weight.cast("long").alias("distance"))), "closure")
    size = lambda rows: rows.agg(F.count(F.lit(1)), F.sum("distance")).first()
    now = size(ways)
    while True:
        on = ways.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("distance").alias("more"))
        longer = ways.join(on, "dst").select("src", F.col("end").alias("dst"), (F.col("distance") + F.col("more")).alias("distance"))
        ways = written(best(ways.unionByName(longer)), "closure")
        before, now = now, size(ways)
        if now == before:
            return ways


def ancestry(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor, distance), each node its own ancestor at 0, by its shortest way up; a depth bounds the way, None goes to the
    top. Parents that are no nodes count as ancestors."""
    edges = nodes.select(F.col("id").alias("src"), F.col("parent_id").alias("dst")).where("dst is not null")
    own = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    up = closure(edges).select(F.col("src").alias("id"), F.col("dst").alias("ancestor"), "distance")
    return own.unionByName(up if depth is None else up.where(F.col("distance") <= depth))


def subtree_sums(nodes: DataFrame, values: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, total, members): the values (id, value) below and at each node; on a ring each member holds all."""
    up = ancestry(nodes, depth)
    sums = values.groupBy("id").agg(F.sum("value").alias("value"))
    return up.join(sums, "id", "left").groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("members"))


def tops(nodes: DataFrame) -> DataFrame:
    """(id, top): the node without a parent above each node, itself where it has none. Nodes jump to their parent's
    parent each round, and those that have arrived rest; what hangs on a ring or on an unknown parent has no top and is left out."""
    state = written(nodes.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), F.col("id")).alias("top")), "tops")
    open_before = -1
    while True:
        waiting = state.where("top is null")
        n = waiting.count()
        if n == 0 or n == open_before:
            # a round that brings nobody in: what is left are rings, for the way to any top halves each round
            return state.where("top is not null").select("id", "top")
        open_before = n
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("top").alias("found"))
        jumped = waiting.drop("top").join(above, "up").select("id", F.col("next").alias("up"), F.col("found").alias("top"))
        state = written(state.where("top is not null").unionByName(jumped), "tops")


def hierarchy_from_indents(lines: DataFrame) -> DataFrame:
    """(doc, pos, indent, name) -> with parent_pos: the nearest line above with a smaller indent. The lines of a document
    meet once, in order, and a stack of open parents is run over them."""
    whole = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "indent", "name"))).alias("lines"))
    whole = whole.withColumn("up", parents_of_indents(F.transform("lines", lambda x: x["indent"].cast("int"))))
    rows = whole.select("doc", "lines", F.explode(F.arrays_zip("lines", "up")).alias("x"))
    parent = F.when(F.col("x.up") >= 0, F.get("lines", F.col("x.up"))["pos"])
    return rows.select("doc", "x.lines.pos", "x.lines.indent", "x.lines.name", parent.alias("parent_pos"))
