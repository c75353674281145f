"""Hard-negative mining by dual-tree search.

A binary tree is fitted on a bounded sample of vectors (the median along the main direction of each node), and
every row is put in its leaf. Candidates are packed leaf by leaf in blocks of about `leaf_rows` rows, anchors
in groups of about `anchor_rows` under a node of the same tree; a leaf that copies make large is as many blocks as it needs.
A leaf has a box and a ball around its rows; those of the nodes above follow from them, at most
2 ** max_depth leaves in all, so candidates' nodes fit in a broadcast whatever the corpus.

A search has three steps. Anchors meet the blocks of their own leaf, which gives each a first threshold. Then each
group of anchors walks down both trees at once: the inner product of two nodes lies in an interval that follows from their boxes
and balls, and the pair is dropped, with all anchors below, if that interval holds nothing that any of them still
looks for. Pairs of leaves that are left are tried once more for each anchor by itself, and the blocks of what then
remains are scored exactly for those anchors.
Two searches run: the nearest rows of the same label, then for each of them the highest rows of other labels in the
window that its score sets. Only pairs of a group and a block travel, and the few best of each pair come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NONE, ALL = -(1 << 62), 1 << 62
#: Node pairs whose intervals are worked out at once.
CHUNK = 2048


@dataclass
class Tree:
    """Node i has children 2i + 1 and 2i + 2; a row goes right where its product with the node's line is above the cut."""

    depth: int
    lines: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + ((rows * self.lines[at]).sum(axis=1) > self.cuts[at])
        return at - (2**self.depth - 1)

    def above(self, leaf: np.ndarray) -> np.ndarray:
        """The nodes on the way from the root to each leaf, one a level."""
        return ((np.asarray(leaf) + 2**self.depth)[:, None] >> np.arange(self.depth, 0, -1)) - 1

    def along(self, rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """How far rows go along the lines above their leaf."""
        return np.stack([(rows * self.lines[at]).sum(axis=1) for at in self.above(leaf).T], axis=1) if self.depth else np.zeros((len(rows), 0))


def fit_tree(sample: np.ndarray, depth: int, dim: int) -> Tree:
    tree = Tree(depth, np.zeros((2**depth - 1, dim)), np.zeros(2**depth - 1), np.zeros((2**depth, dim)))
    members = {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        own = members.pop(node)
        right = np.zeros(len(own), bool)
        if len(own) > 1:
            part = sample[own] - sample[own].mean(axis=0)
            line = part[np.argmax((part**2).sum(axis=1))]
            for _ in range(8):  # power iteration towards the main direction
                line = part.T @ (part @ line)
                line = line / max(np.linalg.norm(line), 1e-12)
            along = sample[own] @ line
            tree.lines[node], tree.cuts[node] = line, np.median(along)
            right = along > tree.cuts[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    for node, own in members.items():
        tree.centres[node - (2**depth - 1)] = sample[own].mean(axis=0) if len(own) else 0
    return tree


@dataclass
class Nodes:
    """Boxes and balls of a tree's nodes, a level after the other from the root; empty nodes have lo > hi. Of candidates' leaves
    also the longest row, and how far rows go along the lines above."""

    lo: list[np.ndarray]
    hi: list[np.ndarray]
    centre: list[np.ndarray]
    radius: list[np.ndarray]
    tree: Tree | None = None
    norm: np.ndarray | None = None
    along_lo: np.ndarray | None = None
    along_hi: np.ndarray | None = None

    def reach(self, rows: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of rows with a leaf's rows from their length and their way along each line above: at its
        most, a row of the leaf points where the other does, unless that leads out of what the leaf has along a line."""
        size = np.linalg.norm(rows, axis=1)
        low, high = -size * self.norm[leaf], size * self.norm[leaf]
        for at, a, b in zip(self.tree.above(np.array([leaf]))[0], self.along_lo[leaf], self.along_hi[leaf], strict=True):
            part = rows @ self.tree.lines[at]
            across = np.sqrt(np.maximum(size**2 - part**2, 0))
            for sign, out in ((1, high), (-1, low)):
                best = np.clip(sign * part * self.norm[leaf] / np.maximum(size, 1e-12), a, b)
                bound = part * best + sign * across * np.sqrt(np.maximum(self.norm[leaf] ** 2 - best**2, 0))
                (np.minimum if sign > 0 else np.maximum)(out, bound, out=out)
        slack = 1 + 1e-9 * size * self.norm[leaf]
        return low - slack, high + slack

    def at(self, level: int, which: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x[level][which] for x in (self.lo, self.hi, self.centre, self.radius))

    @classmethod
    def above(cls, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> Nodes:
        """From leaves, as many as a power of two, to the root."""
        levels = [(lo, hi, centre, radius)]
        while len(levels[0][0]) > 1:
            lo, hi, centre, radius = levels[0]
            full = (lo[:, 0] <= hi[:, 0]).astype(float).reshape(-1, 2)
            middle = (centre.reshape(-1, 2, centre.shape[1]) * full[:, :, None]).sum(axis=1) / np.maximum(full.sum(axis=1), 1)[:, None]
            away = np.linalg.norm(centre.reshape(-1, 2, centre.shape[1]) - middle[:, None, :], axis=2) + radius.reshape(-1, 2)
            levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), middle, np.where(full > 0, away, 0).max(axis=1)))
        return cls(*map(list, zip(*levels, strict=True)))


def interval(a: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of rows of two nodes, pair by pair, a little wide for rounding."""
    (alo, ahi, ac, ar), (clo, chi, cc, cr) = a, c
    corners = np.stack([alo * clo, alo * chi, ahi * clo, ahi * chi])
    low, high = corners.min(axis=0).sum(axis=1), corners.max(axis=0).sum(axis=1)
    middle = (ac * cc).sum(axis=1)
    spread = np.linalg.norm(ac, axis=1) * cr + np.linalg.norm(cc, axis=1) * ar + ar * cr
    slack = 1 + 1e-9 * (np.abs(low) + np.abs(high) + np.abs(middle) + spread)
    return np.maximum(low, middle - spread) - slack, np.minimum(high, middle + spread) + slack


@dataclass
class Anchors:
    """A group of anchors in the order of their leaves: a slot of each looks for scores from low to high, for the row `to`."""

    leaf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    to: np.ndarray
    base: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, dim: int, kind: str) -> Anchors:
        table = table.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        slots = [sorted(x, key=lambda s: (-s["base"], s["to"])) for x in table.column("slots").to_pylist()]
        width = max(map(len, slots), default=0)
        blank = {"to": -1, "base": 0, "low": ALL, "high": NONE}  # looks for nothing
        padded = [x + [blank] * (width - len(x)) for x in slots]
        parts = (np.array([[s[f] for s in x] for x in padded], np.int64).reshape(len(slots), width) for f in ("to", "base", "low", "high"))
        rows = np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(-1, dim)
        return cls(*(table.column(c).to_numpy() for c in ("leaf", "vec_id", "label")), rows, *parts)

    def packed(self, leaf: int, keep: np.ndarray) -> list:
        own = (self.ids, self.labels, self.rows, self.to, self.base, self.low, self.high)
        return [leaf, *(np.ascontiguousarray(x[keep]).tobytes() for x in own)]


TASK = "leaf long, ids binary, labels binary, vecs binary, to binary, base binary, low binary, high binary"
TASK_SCHEMA = pa.schema([("leaf", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "vecs", "to", "base", "low", "high"))])


def wanted_above(least: np.ndarray, most: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What anchors below a node look for at least and at most, a level after the other from the root."""
    levels = [(least, most)]
    while len(levels[0][0]) > 1:
        least, most = levels[0]
        levels.insert(0, (np.minimum(least[::2], least[1::2]), np.maximum(most[::2], most[1::2])))
    return levels


def anchor_nodes(group: Anchors, leaves: int) -> Nodes:
    lo, hi = np.full((leaves, group.rows.shape[1]), np.inf), np.full((leaves, group.rows.shape[1]), -np.inf)
    np.minimum.at(lo, group.leaf, group.rows)
    np.maximum.at(hi, group.leaf, group.rows)
    has = lo[:, :1] <= hi[:, :1]
    centre = np.where(has, (np.where(has, lo, 0) + np.where(has, hi, 0)) / 2, 0)
    radius = np.zeros(leaves)
    np.maximum.at(radius, group.leaf, np.linalg.norm(group.rows - centre[group.leaf], axis=1))
    return Nodes.above(lo, hi, centre, radius)


def walked(group: Anchors, nodes: Nodes) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf of candidates, anchors that can't be ruled out there) from walking down both trees at once; own leaves apart."""
    leaves = len(nodes.lo[-1])
    own = anchor_nodes(group, leaves)
    least, most = np.full(leaves, np.inf), np.full(leaves, -np.inf)
    np.minimum.at(least, group.leaf, group.low.min(axis=1))
    np.maximum.at(most, group.leaf, group.high.max(axis=1))
    wanted = wanted_above(least, most)
    a = c = np.zeros(1, np.int64)
    for level, (least, most) in enumerate(wanted):
        if level:  # four pairs of children of each pair
            a, c = np.repeat(2 * a, 4) + np.tile([0, 0, 1, 1], len(a)), np.repeat(2 * c, 4) + np.tile([0, 1, 0, 1], len(c))
        kept = []
        for i in range(0, len(a), CHUNK):
            x, y = a[i : i + CHUNK], c[i : i + CHUNK]
            real = (own.lo[level][x, 0] <= own.hi[level][x, 0]) & (nodes.lo[level][y, 0] <= nodes.hi[level][y, 0])
            x, y = x[real], y[real]
            bottom, top = interval(own.at(level, x), nodes.at(level, y))
            fine = (top >= least[x]) & (bottom <= most[x])
            kept.append((x[fine], y[fine]))
        a, c = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (a[:0], c[:0])
    order = np.argsort(c, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(c[order])) + 1) if len(c) else []:
        leaf = int(c[part[0]])
        at = np.flatnonzero(np.isin(group.leaf, a[part]) & (group.leaf != leaf))
        # last, each anchor by itself against the leaf: a node without width
        rows = group.rows[at].astype(float)
        bottom, top = interval((rows, rows, rows, np.zeros(len(at))), nodes.at(-1, np.full(len(at), leaf)))
        if nodes.tree:
            shortest, longest = nodes.reach(rows, leaf)
            bottom, top = np.maximum(bottom, shortest), np.minimum(top, longest)
        keep = np.zeros(len(group.leaf), bool)
        keep[at] = (top >= group.low[at].min(axis=1)) & (bottom <= group.high[at].max(axis=1))
        if keep.any():
            yield leaf, keep


def tasks(anchors: DataFrame, nodes: Broadcast[Nodes], dim: int, kind: str, own: bool) -> DataFrame:
    """What to score exactly: a leaf and the anchors of a group that meet it, packed. own: only each anchor's own leaf."""

    def work(table: pa.Table) -> pa.Table:
        group = Anchors.of(table, dim, kind)
        pairs = ((int(x), group.leaf == x) for x in np.unique(group.leaf)) if own else walked(group, nodes.value)
        found = [group.packed(leaf, keep) for leaf, keep in pairs]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), TASK_SCHEMA, strict=True)] if found else [pa.array([], f.type) for f in TASK_SCHEMA], schema=TASK_SCHEMA)

    return anchors.groupBy("node", "part").applyInArrow(work, TASK)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: as doubles where none can pass 2 ** 53."""
    reach = np.abs(a.astype(float)).max(initial=0) * np.abs(c.astype(float)).max(initial=0) * max(1, a.shape[1])
    return (a.astype(float) @ c.astype(float).T).astype(np.int64) if reach < 2.0**53 else a.astype(np.int64) @ c.astype(np.int64).T


def leading(scores: np.ndarray, fine: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `most` highest fine scores of each row, ties by the smaller id."""
    some = np.flatnonzero(fine.any(axis=1))
    held = np.where(fine[some], scores[some], NONE)
    if held.shape[1] > most:
        cut = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
        row, col = np.nonzero((held >= cut[:, None]) & fine[some])
    else:
        row, col = np.nonzero(fine[some])
    order = np.lexsort((ids[col], -held[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < most
    return some[row[keep]], col[keep]


def scored(work: DataFrame, blocks: DataFrame, dim: int, kind: str, most: int, same: bool) -> DataFrame:
    """(anchor_id, to, base, cand, score): the best of each slot in each block."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "to", "base", "cand", "score")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, cand_ids, cand_labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "cand_ids", "cand_labels"))
                a, c = (np.frombuffer(r[x], kind).reshape(-1, dim) for x in ("vecs", "cand_vecs"))
                to, base, low, high = (np.frombuffer(r[x], np.int64).reshape(len(ids), -1) for x in ("to", "base", "low", "high"))
                scores = products(a, c)
                fit = ((labels[:, None] == cand_labels) == same) & (ids[:, None] != cand_ids)
                for k in range(to.shape[1]):
                    i, j = leading(scores, fit & (scores >= low[:, k : k + 1]) & (scores <= high[:, k : k + 1]), cand_ids, most)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], to[i, k], base[i, k], cand_ids[j], scores[i, j])], schema=schema)

    # the size that Spark guesses for packed tasks is that of their anchors: without the hint they would go through the driver
    return work.hint("merge").join(blocks, "leaf").drop("leaf", "part").mapInArrow(rows, "anchor_id long, to long, base long, cand long, score long")


def ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "to").orderBy(F.desc("score"), "cand")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(anchors: DataFrame, slots: DataFrame, blocks: DataFrame, nodes: Broadcast[Nodes], dim: int, kind: str, most: int, same: bool) -> DataFrame:
    """The `most` best rows of each slot (anchor_id, to, base, low, high): (anchor_id, to, base, cand, score, rank)."""

    def with_slots(own: DataFrame) -> DataFrame:
        lists = own.groupBy("anchor_id").agg(F.collect_list(F.struct("to", "base", "low", "high")).alias("slots"))
        return anchors.join(lists.withColumnRenamed("anchor_id", "vec_id").hint("merge"), "vec_id")

    first = written(scored(tasks(with_slots(slots), nodes, dim, kind, own=True), blocks, dim, kind, most, same), "first-scores")
    least = ranked(first, most).where(F.col("rank") == most).select("anchor_id", "to", F.col("score").alias("least"))
    narrowed = slots.join(least.hint("merge"), ["anchor_id", "to"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).drop("least")
    rest = scored(tasks(with_slots(narrowed), nodes, dim, kind, own=False), blocks, dim, kind, most, same)
    return ranked(first.unionByName(rest), most)


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): what takes part, with moved labels and whole components."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("vec"))


def as_matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of one width, short ones filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def placed(rows: DataFrame, tree: Broadcast[Tree], dim: int, kind: str) -> DataFrame:
    """(vec_id, label, leaf, vec) with the vector as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = as_matrix(batch.column("vec"), dim)
            leaf = tree.value.leaf_of(found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(leaf), pa.array([x.tobytes() for x in found.astype(kind)])], names=["vec_id", "label", "leaf", "vec"])

    return rows.select("vec_id", "label", "vec").mapInArrow(work, "vec_id long, label long, leaf long, vec binary")


def leaf_nodes(rows: DataFrame, tree: Broadcast[Tree], dim: int, kind: str) -> Nodes:
    """Boxes and balls of the leaves that have rows, and of what is above them: minima and maxima by leaf and measure, which are the
    components, the distance from the centre, the length, and the ways along the lines above."""
    width = dim + 2 + tree.value.depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = len(tree.value.centres)
        lo, hi = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf)
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            found = np.frombuffer(b"".join(batch.column("vec").to_pylist()), kind).reshape(-1, dim).astype(float)
            sizes = [np.linalg.norm(x, axis=1) for x in (found - tree.value.centres[leaf], found)]
            found = np.column_stack([found, *sizes, tree.value.along(found, leaf)])
            np.minimum.at(lo, leaf, found)
            np.maximum.at(hi, leaf, found)
        leaf, at = np.nonzero(lo <= hi)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(at), pa.array(lo[leaf, at]), pa.array(hi[leaf, at])], names=["leaf", "at", "lo", "hi"])

    found = rows.select("leaf", "vec").mapInArrow(work, "leaf long, at long, lo double, hi double").groupBy("leaf", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    leaf, at = (found.column(c).to_numpy() for c in ("leaf", "at"))  # at most 2 ** max_depth * (dim + 2 + max_depth) rows
    lo, hi = np.full((len(tree.value.centres), width), np.inf), np.full((len(tree.value.centres), width), -np.inf)
    lo[leaf, at], hi[leaf, at] = found.column("lo").to_numpy(), found.column("hi").to_numpy()
    out = Nodes.above(lo[:, :dim], hi[:, :dim], tree.value.centres, np.maximum(hi[:, dim], 0))
    out.tree, out.norm, out.along_lo, out.along_hi = tree.value, hi[:, dim + 1], lo[:, dim + 2 :], hi[:, dim + 2 :]
    return out


def in_parts(rows: DataFrame, by: str, size: int) -> DataFrame:
    """With `part`: rows of one `by` fall by hash into parts of about `size`. `by` has at most 2 ** max_depth values."""
    parts = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    return rows.join(F.broadcast(parts), by).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).drop("parts")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(leaf, part, cand_ids, cand_labels, cand_vecs): about `size` rows of a leaf as bytes."""

    def work(table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy().tobytes() for c in ("vec_id", "label"))
        found = [[table.column(c)[0].as_py()] for c in ("leaf", "part")] + [[ids], [labels], [b"".join(table.column("vec").to_pylist())]]
        return pa.Table.from_arrays([pa.array(x) for x in found], names=["leaf", "part", "cand_ids", "cand_labels", "cand_vecs"])

    return in_parts(rows, "leaf", size).groupBy("leaf", "part").applyInArrow(work, "leaf long, part long, cand_ids binary, cand_labels binary, cand_vecs binary")


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, window: tuple[int, int] = (50, 95),
    leaf_rows: int = 1024, anchor_rows: int = 1024, max_depth: int = 12, sample: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose vec_id is divisible
    by `every`, and each of its `positives` best rows of the same label, the `negatives` best rows of other labels whose score
    is `window` hundredths of the positive's.

    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part. Rows with one
    vec_id are one: that with the least label and vector counts. Shorter vectors are filled with zeros. Floors beyond 64
    bits are cut to them, and inner products beyond 64 bits are not supported. Other columns are not read; an empty table,
    or one without anchors, gives no rows. `sample` bounds the rows that fit the tree; it changes no result.
    """
    context = vectors.sparkSession.sparkContext
    rows = written(integer_rows(vectors), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(F.size("vec")).alias("dim"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    if facts.ids < facts.n:
        rows = written(rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec"), "vectors")
    dim = max(1, facts.dim or 1)
    kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 64)) if (facts.most or 0) < top)
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, facts.ids) / leaf_rows)))))
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()  # at most `sample` rows
    tree = context.broadcast(fit_tree(as_matrix(few, dim).astype(float), depth, dim))
    leaves = written(placed(rows, tree, dim, kind), "leaves")
    nodes = context.broadcast(leaf_nodes(leaves, tree, dim, kind))
    blocks = written(in_blocks(leaves, leaf_rows), "blocks")
    level = min(depth, max(0, int(np.log2(max(1, facts.ids / every / anchor_rows)))))
    anchors = leaves.where(F.col("vec_id") % every == 0).withColumn("node", F.shiftright("leaf", depth - level))
    anchors = written(in_parts(anchors, "node", anchor_rows), "anchors")
    whole = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("to"), F.lit(0).cast("long").alias("base"), F.lit(NONE).cast("long").alias("low"), F.lit(ALL).cast("long").alias("high"))
    near = search(anchors, whole, blocks, nodes, dim, kind, positives, same=True)
    # hundreds and the rest apart, so that nothing overflows; a window below 0 is empty: from 1 to 0
    low, high = (F.when(F.col("score") < 0, x).otherwise(F.expr(f"score div 100 * {part} + (score % 100 * {part} + {more}) div 100")) for x, part, more in ((1, window[0], 99), (0, window[1], 0)))
    slots = written(near.select("anchor_id", F.col("cand").alias("to"), F.col("score").alias("base"), low.cast("long").alias("low"), high.cast("long").alias("high")), "positives")
    found = search(anchors, slots, blocks, nodes, dim, kind, negatives, same=False)
    return found.select("anchor_id", F.col("to").alias("positive_id"), "rank", F.col("cand").alias("negative_id"), F.col("base").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, c.vec_id as cand, a.label = c.label as same, cast(list_inner_product(a.vec, c.vec) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, cand as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, cand) <= 5
), found as (
  select p.*, s.cand as negative_id, s.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.cand) as int) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from found where rank <= 3
"""
