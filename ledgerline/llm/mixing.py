"""Mixing sources to target weights, by blocks and a splitting tree.

Each source's documents fall by hash into blocks of about `block_bytes`, so blocks are as many as the
data asks for, and a fixed permutation orders them. The source's word quota becomes whole epochs plus a
run of leading blocks; the last block of the run is cut inside, by a running sum over that block alone.
A multivariate-hypergeometric splitting tree deals the sources' block draws among output shards: at each
node the left half of the shards gets an exact number of draws and how many of each source is drawn
without replacement. The tree grows by levels of at most 2 * FANOUT nodes a task, kept as a table.
Consecutive draws of a source go to consecutive shards, so shards hold disjoint runs of permuted blocks,
and documents are shuffled inside their shard. Texts move once, to their shard; only those of cut blocks
meet by block before. All sums are per (source, block), combined before the shuffle; a source with a
third of all rows is as many blocks as any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
SOURCES_PER_TREE = 256
#: Shards that a task splits off a node of the tree, at most twice as many.
FANOUT = 1024
#: Stretches of a source's permutation whose sums meet in one window.
STRETCHES = 1024


@dataclass
class Plan:
    """placed: the rows with block and order; sources, blocks: what is taken of each."""

    placed: DataFrame
    sources: DataFrame
    blocks: DataFrame


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """The target of each source: weight shares, capped at `most` times its size, the excess reshared
    by weight until none is above. That is one level L with target = min(most * size, weight * L):
    a source is capped if giving all others weight * (its own cap per weight) stays within the budget.

    One row per source goes through a single window; documents never do.
    """
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    rows = sources.withColumns({"rank": rank.cast("long"), "weight": weight})
    cap = F.col("source_size") * F.lit(most)
    rows = rows.withColumns({"cap": cap, "turn": cap / F.col("weight"), "budget": F.sum("source_size").over(one) * share, "all_weight": F.sum("weight").over(one)})
    upto = one.orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"cap_upto": F.sum("cap").over(upto), "weight_upto": F.sum("weight").over(upto)})
    rows = rows.withColumn("capped", F.col("cap_upto") + F.col("turn") * (F.col("all_weight") - F.col("weight_upto")) <= F.col("budget"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(one)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(one)
    rows = rows.withColumn("level", (F.col("budget") - spent) / F.nullif(free, F.lit(0.0)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return rows.select("source", "rank", "source_size", "n_blocks", target.alias("target"))


def source_key() -> Column:
    """A key that is never null."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))


def order_hash(seed: int, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def placed(docs: DataFrame, keep: list[str], block_bytes: int, seed: int) -> DataFrame:
    """`keep` columns as `row`, under their own names: ours can't clash; and key, source, block, place, id."""
    text = text_of()
    place = order_hash(seed, F.col("doc_id").cast("string"), F.length(text))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source").cast("string").alias("source"),
        text.alias("text"), place.alias("place"), F.col("doc_id").cast("string").alias("id"),
    ).withColumn("key", source_key())
    bytes_of = docs.select(F.col("source").cast("string").alias("source"), F.octet_length(text).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    many = written(bytes_of.select(source_key().alias("key"), F.ceil(F.greatest(F.col("n"), F.lit(1)) / block_bytes).alias("blocks")), "mix-sizes")
    return rows.join(many, "key").withColumn("block", F.pmod("place", F.col("blocks"))).drop("blocks")


def planned(docs: DataFrame, keep: list[str], weights: tuple[int, ...], share: float, most: float, block_bytes: int, seed: int) -> Plan:
    rows = placed(docs, keep, block_bytes, seed)
    counted = written(rows.groupBy("source", "block").agg(F.sum(size_of(F.col("text"))).alias("words")), "mix-blocks")
    sources = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size"), F.count_if(F.col("words") > 0).alias("n_blocks")), weights, share, most)
    quota = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    sources = written(sources.withColumns({"epochs": whole, "rest": quota - whole * F.col("source_size")}), "mix-sources")
    # blocks without words come last, so that those that are drawn are numbered without holes; a source's
    # blocks are summed up stretch by stretch
    turn = order_hash(seed + 1, "block")
    stretch = F.when(F.col("words") == 0, STRETCHES).otherwise(F.pmod(turn, F.lit(STRETCHES)))
    keyed = counted.withColumns({"key": source_key(), "turn": turn, "stretch": stretch}).drop("source")
    earlier = Window.partitionBy("key").orderBy("stretch")
    sums = keyed.groupBy("key", "stretch").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("key", "stretch", (F.sum("w").over(earlier) - F.col("w")).alias("words_before"), (F.sum("n").over(earlier) - F.col("n")).alias("n_before"))
    by = Window.partitionBy("key", "stretch").orderBy("turn", "block")
    ranked = keyed.join(sums, ["key", "stretch"]).join(sources.withColumn("key", source_key()).drop("source"), "key")
    before = F.col("words_before") + F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    extra = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - before))
    return Plan(rows, sources, ranked.withColumns({"nth": F.col("n_before") + F.row_number().over(by) - 1, "extra": extra}).drop("turn", "stretch", "words_before", "n_before"))


def upto_in_block() -> Column:
    """The words of a block up to and with a row, in its order."""
    return F.sum("size").over(Window.partitionBy("key", "block").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def within(most: str) -> Column:
    """The words of a row inside the first `most` of its block."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col(most) - F.col("upto") + F.col("size")))


def split(draws: np.ndarray, shards: int, random: np.random.Generator, leaf: int = 1) -> np.ndarray:
    """Draws of each source for each node of `leaf` shards at most: exact totals per source, node totals by
    their shards within one."""
    if shards <= leaf:
        return draws[:, None]
    left = shards // 2
    total = int(draws.sum())
    size = total * left // shards
    # a source at a time: the multivariate draw as conditional hypergeometric draws
    first = np.zeros_like(draws)
    rest, need = total, size
    for i, n in enumerate(draws.tolist()):
        rest -= n
        first[i] = need if rest == 0 else random.hypergeometric(n, rest, need) if need and n else 0
        need -= int(first[i])
    return np.concatenate((split(first, left, random, leaf), split(draws - first, shards - left, random, leaf)), axis=1)


def node_sizes(shards: int, leaf: int = 1) -> list[int]:
    """Shards of the nodes of split(), in order."""
    return [shards] if shards <= leaf else node_sizes(shards // 2, leaf) + node_sizes(shards - shards // 2, leaf)


def grown(part: pd.DataFrame, leaf: int, seed: int) -> pd.DataFrame:
    """The nodes of `leaf` shards at most below one node: (rank, tree, shard, width, lo, hi) to the same."""
    part = part.sort_values("rank")
    first, width, ranks = int(part["shard"].iloc[0]), int(part["width"].iloc[0]), part["rank"].to_numpy()
    sizes = np.array(node_sizes(width, leaf))
    draws = split((part["hi"] - part["lo"]).to_numpy(np.int64), width, np.random.default_rng([seed, int(ranks.min()), first, width]), leaf)
    hi = part["lo"].to_numpy()[:, None] + draws.cumsum(axis=1)
    n, k = draws.shape
    starts = first + np.cumsum(sizes) - sizes
    return pd.DataFrame({"rank": np.repeat(ranks, k), "tree": int(part["tree"].iloc[0]), "shard": np.tile(starts, n), "width": np.tile(sizes, n), "lo": (hi - draws).ravel(), "hi": hi.ravel()})


def shard_runs(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, shard, lo, hi): which of a source's draws go to which shard. A tree takes up to
    SOURCES_PER_TREE sources and a task one node of a level, so its size is bounded however many sources
    and shards there are."""
    node = F.floor(F.col("rank") / SOURCES_PER_TREE).alias("tree"), F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("width")
    rows = sources.select("rank", *node, F.lit(0).cast("long").alias("lo"), F.col("draws").alias("hi"))
    leaf = shards
    while leaf > 1:
        leaf = -(-leaf // FANOUT)
        rows = rows.groupBy("tree", "shard").applyInPandas(level(leaf, seed), "rank long, tree long, shard long, width long, lo long, hi long").where("hi > lo")
    return rows.where("hi > lo").select("rank", "shard", "lo", "hi")


def level(leaf: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda part: grown(part, leaf, seed)


def dealt(plan: Plan, seed: int, words_per_shard: int) -> DataFrame:
    """(key, block, words, extra, epoch, shard): a row per draw of a block, with the words that it takes."""
    total = plan.sources.agg(F.sum("target")).first()[0] or 0
    shards = max(1, int(total // words_per_shard))
    used = plan.blocks.groupBy("rank", "n_blocks", "epochs").agg(F.sum((F.col("extra") > 0).cast("long")).alias("n"))
    used = used.select("rank", (F.col("epochs") * F.col("n_blocks") + F.col("n")).alias("draws"))
    # draws and runs meet by stretches of the draws, each about as long as a run
    stretch = used.select("rank", F.ceil(F.greatest(F.col("draws"), F.lit(1)) / shards).alias("stretch"))
    runs = shard_runs(used, shards, seed).join(stretch, "rank")
    runs = runs.withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") / F.col("stretch")), F.floor((F.col("hi") - 1) / F.col("stretch"))))).drop("stretch")
    copies = plan.blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    copies = copies.where((F.col("words") > 0) & ((F.col("epoch") < F.col("epochs")) | (F.col("extra") > 0))).withColumn("draw", F.col("epoch") * F.col("n_blocks") + F.col("nth"))
    copies = copies.join(stretch, "rank").withColumn("at", F.floor(F.col("draw") / F.col("stretch")))
    extra = F.when(F.col("epoch") < F.col("epochs"), F.col("words")).otherwise(F.col("extra"))
    return written(copies.join(runs, ["rank", "at"]).where("draw >= lo and draw < hi").select("key", "block", "words", extra.alias("extra"), "epoch", "shard"), "mix-draws")


def mixing_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_bytes: int = 1 << 20, seed: int = 7, words_per_shard: int = 4 << 20) -> DataFrame:
    """One row per document with the words that the mix takes of it: the sum over the draws of its block
    that `mix` deals to shards. Texts don't move, and rows aren't shuffled inside a shard, which takes nothing.

    A null text has size 0; a null source is a source of its own, the last; a null doc_id stays null
    and is placed by its text's length; equal rows are taken one by one, in an order that may be either's since
    they are equal. Other columns are not read; an empty table, or one without words, takes nothing.
    """
    plan = planned(docs, ["doc_id"], weights, share, most, block_bytes, seed)
    full = F.col("extra") == F.col("words")
    drawn = dealt(plan, seed, words_per_shard).groupBy("key", "block").agg(F.count_if(full).alias("times"), F.sum(F.when(~full, F.col("extra"))).alias("part"))
    blocks = plan.blocks.select("key", "block", "source_size", "target").join(drawn, ["key", "block"], "left")
    sized = plan.placed.select("key", "block", "place", "id", F.col("row.doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"))
    rows = sized.withColumn("upto", upto_in_block()).join(blocks, ["key", "block"])
    taken = F.col("times") * F.col("size") + F.when(F.col("part").isNull(), 0).otherwise(within("part"))
    return rows.select("doc_id", "size", "source_size", "target", F.when(F.col("times").isNull(), 0).otherwise(taken).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_bytes: int = 1 << 20, seed: int = 7, words_per_shard: int = 4 << 20) -> DataFrame:
    """The mixed documents, same columns, a row per copy, shard after shard and shuffled inside.

    The one document per source at which the quota ends is taken up to that word; n_chars follows.
    Documents without words are not taken. Nulls and repeats as in mixing_report.
    """
    keep = [c for c in docs.columns if c != "text"]  # the text goes beside them
    plan = planned(docs, keep, weights, share, most, block_bytes, seed)
    draws = dealt(plan, seed, words_per_shard)
    base = plan.placed.drop("source").where(F.col("text").rlike(WORD))
    columns = ["row", "text", "place", "id", "epoch", "shard"]
    full = base.join(draws.where("extra = words"), ["key", "block"]).select(*columns, F.lit(None).cast("long").alias("more"))
    part = base.join(draws.where("extra < words"), ["key", "block"]).withColumn("size", size_of(F.col("text"))).withColumn("upto", upto_in_block())
    part = part.withColumn("more", within("extra")).where("more > 0").select(*columns, F.when(F.col("more") < F.col("size"), F.col("more")).alias("more"))
    rows = full.unionByName(part).repartition("shard").sortWithinPartitions("shard", order_hash(seed + 2, "place", "epoch"), "id")
    cut = F.array_join(F.slice(F.split("text", WORD_END, -1), F.lit(1), F.col("more").cast("int")), "")
    new = {"text": F.when(F.col("more").isNull(), F.col("text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("more").isNull(), F.col("row.n_chars")).otherwise(F.length(cut))
    kinds = dict(docs.dtypes)
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns])
