"""Nested JSON documents that a reader gets as they are: a company's debt, and trees of entities."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph

#: Nodes of a tree that are Python objects at once.
PIECE = 1 << 14

#: What an instrument shows in its company's document, by the column it comes from.
SHOWN = {
    "id": "id", "name": "name", "instrument_type": "type", "seniority": "seniority", "issuer": "issuer", "principal": "principal", "outstanding": "outstanding",
    "rate_type": "rate_type", "rate_bps": "interest_rate", "benchmark": "benchmark", "maturity_date": "maturity_date", "guarantor_count": "guarantor_count", "guarantors": "guarantors",
}


def debt_documents(companies: DataFrame, instruments: DataFrame, entities: DataFrame, guarantees: DataFrame) -> DataFrame:
    """(company_id, document): each company's active debt as JSON: a summary with debt by seniority, then its instruments
    by id with their guarantors by name. Null fields are left out; a company without debt has an empty list and no debt. A
    guarantor that is no known entity isn't named or counted."""
    named = guarantees.select("instrument_id", F.col("guarantor_entity").alias("guarantor")).distinct().join(entities.select(F.col("id").alias("guarantor"), F.col("name").alias("guarantor_name")), "guarantor")
    givers = named.groupBy(F.col("instrument_id").alias("id")).agg(F.sort_array(F.collect_list("guarantor_name")).alias("guarantors"))
    rows = instruments.where("is_active").join(givers, "id", "left").join(entities.select(F.col("id").alias("issuer_id"), F.col("name").alias("issuer")), "issuer_id", "left")
    rows = rows.withColumn("guarantors", F.coalesce("guarantors", F.array().cast("array<string>"))).withColumn("guarantor_count", F.size("guarantors"))
    debt = rows.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in SHOWN.items()]))).alias("instruments"),
        F.coalesce(F.sum("outstanding"), F.lit(0)).alias("total_debt"), F.count(F.lit(1)).alias("instrument_count"), F.min("maturity_date").alias("nearest_maturity"),
    )
    ranks = rows.groupBy("company_id", F.coalesce("seniority", F.lit("unknown")).alias("rank")).agg(F.coalesce(F.sum("outstanding"), F.lit(0)).alias("amount"))
    by_rank = ranks.groupBy("company_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "amount")))).alias("debt_by_seniority"))
    whole = companies.select(F.col("id").alias("company_id"), "ticker").join(debt, "company_id", "left").join(by_rank, "company_id", "left")
    summary = F.struct(
        F.coalesce("total_debt", F.lit(0)).alias("total_debt"), F.coalesce("debt_by_seniority", F.create_map().cast("map<string,bigint>")).alias("debt_by_seniority"),
        F.coalesce("instrument_count", F.lit(0)).alias("instrument_count"), "nearest_maturity",
    )
    listed = F.when(F.col("instruments").isNull(), F.lit("[]")).otherwise(F.to_json("instruments"))
    head = F.to_json(F.struct(F.struct("ticker").alias("company"), summary.alias("summary")))
    return whole.select("company_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"instruments":'), listed, F.lit("}")).alias("document"))


def nested(ids: pa.Array, parents: pa.Array, bodies: pa.Array, own: np.ndarray, names: tuple[str, ...], levels: int | None) -> str:
    """One tree's JSON from its nodes: parents before children, children by id, and, where there are sums (a column of `own` each), the sum over
    the node and all below. Nodes are numbers here and take their places level by level, so a tree costs its text and a few numbers a node."""
    up = pc.fill_null(pc.index_in(parents, ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    by_parent = pc.sort_indices(pa.table({"up": up, "id": ids}), [("up", "ascending"), ("id", "ascending")]).to_numpy().astype(np.int64)
    starts = np.searchsorted(up[by_parent], np.arange(len(up) + 1))
    root = int(pc.index(pc.is_null(parents), True).as_py())
    depth, rows = np.zeros(len(up), np.int64), [np.array([root])]
    while len(rows[-1]) and (levels is None or len(rows) <= levels):
        above = rows[-1]
        sizes = starts[above + 1] - starts[above]
        below = by_parent[np.repeat(starts[above] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        depth[below] = len(rows)
        rows.append(below)
    size, sums = np.ones(len(up), np.int64), own.copy()
    for row in rows[:0:-1]:
        np.add.at(size, up[row], size[row])
        np.add.at(sums, up[row], sums[row])
    place = np.zeros(len(up), np.int64)
    for row in rows[1:]:
        before = np.cumsum(size[row]) - size[row]
        first = np.flatnonzero(np.diff(up[row], prepend=-1))
        place[row] = place[up[row]] + 1 + before - np.repeat(before[first], np.diff(first, append=len(row)))
    kept = np.concatenate(rows)
    order = np.empty(len(kept), np.int64)
    order[place[kept]] = kept
    deep = np.append(depth[order], 0)
    closed = deep[:-1] - deep[1:] + 1
    out = io.StringIO()
    for i in range(0, len(order), PIECE):
        part = order[i : i + PIECE]
        for body, values, shut in zip(bodies.take(pa.array(part)).to_pylist(), sums[part].tolist(), closed[i : i + PIECE].tolist(), strict=True):
            extra = "".join(f',"subtree_{n}":{v}' for n, v in zip(names, values, strict=True))
            out.write(f'{body[:-1]}{extra},"children":[{"]}" * shut}')
            if shut:
                out.write(",")
    return out.getvalue()[:-1]


def tree_documents(nodes: DataFrame, fields: list[str], levels: int | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """(id, document) of each node without a parent: its fields, `id` among them, `subtree_<name>` for each of the whole numbers in `sums`,
    null as 0, and its `children` in turn, by id. Trees of any depth; `levels` cuts what is further below a root, out of sums too. What
    hangs on a ring or an unknown parent has no root and is left out. Ids are unique and not null; a tree meets in one task, as its
    document does."""
    body = F.to_json(F.struct("id", *[f for f in fields if f != "id"]))
    own = F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in sums]).cast("array<bigint>")
    rows = nodes.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), body.alias("body"), own.alias("own"), F.col("id").alias("key"))

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = batch.column("tree")[i].values
                ids, parents, bodies, values = (tree.field(c) for c in ("id", "parent_id", "body", "own"))
                table = values.flatten().to_numpy(zero_copy_only=False).reshape(len(tree), len(sums))
                # sums that whole numbers of 64 bits might not hold are Python's
                table = table.astype(object if np.abs(table.astype(float)).sum() > 2.0**62 else np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("top").slice(i, 1), pa.array([nested(ids, parents, bodies, table, sums, levels)], pa.string())], ["id", "document"])
            tree = ids = parents = bodies = values = batch = None  # nothing of it stays while the next ones come

    grouped = rows.join(graph.tops(nodes).withColumnRenamed("id", "key"), "key").groupBy("top").agg(F.collect_list(F.struct("id", "parent_id", "body", "own")).alias("tree"))
    top = grouped.schema["top"].dataType
    return grouped.mapInArrow(document, T.StructType([T.StructField("id", top), T.StructField("document", T.StringType())]))
