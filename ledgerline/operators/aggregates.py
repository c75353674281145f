"""Aggregates and windows that the screens and pipelines share, all from built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written


def upper_median(value: Column) -> Column:
    """sorted[n // 2]: the upper of two middle values. The group's values are held together, so this is
    for groups of bounded size; use percentile_approx beyond."""
    values = F.sort_array(F.collect_list(value))
    return F.when(F.size(values) > 0, F.get(values, F.floor(F.size(values) / 2).cast("int")))


def weighted_average(value: Column, weight: Column) -> Column:
    """Over rows with both present and not 0."""
    both = value.isNotNull() & weight.isNotNull() & (value != 0) & (weight != 0)
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def weighted_maturity(outstanding: Column, maturity: Column, today: Column, most: float = 999.9) -> Column:
    """Years to maturity by amount, over the whole debt, that without a date in it: past dates count as 0, `most` years at most;
    null without debt."""
    years = F.greatest(F.datediff(maturity, today), F.lit(0)) / F.lit(365.0)
    total = F.coalesce(F.sum(outstanding), F.lit(0))
    return F.when(total > 0, F.least(F.coalesce(F.sum(outstanding * years), F.lit(0.0)) / total, F.lit(most)))


def numbered(rows: DataFrame, *order: Column | str, name: str = "nth") -> DataFrame:
    """Rows numbered from 1 in one order over all of them, without bringing them to one task: sorted by range and kept, numbered in
    each range, and moved by the counts of the ranges before, of which there are as many as partitions. The order should have no ties."""
    placed = written(rows.orderBy(*order).withColumn("ledgerline_part", F.spark_partition_id()), "numbered")
    parts = placed.groupBy("ledgerline_part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("ledgerline_part", (F.sum("n").over(Window.orderBy("ledgerline_part")) - F.col("n")).alias("ledgerline_before"))
    own = F.row_number().over(Window.partitionBy("ledgerline_part").orderBy(*order))
    return placed.withColumn(name, own.cast("long")).join(F.broadcast(before), "ledgerline_part").withColumn(name, F.col(name) + F.col("ledgerline_before")).drop("ledgerline_part", "ledgerline_before")


def ordered_ids(key: Column, *order: Column) -> Column:
    """Ids in the order of `order` ascending (negate for descending), ties by id."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], key.alias("id")))), lambda x: x["id"])


def buckets(value: Column, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    """The label of the first bound that the value doesn't exceed, the last label beyond."""
    out = F.when(value.isNull(), None)
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(value <= bound, label)
    return out.otherwise(labels[-1])


def latest_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def period_change(now: Column, before: Column) -> Column:
    """Percent against the period before; from nothing, 100 if there is something now, else 0."""
    return F.when(F.coalesce(before, F.lit(0)) == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise((now - before) * 100.0 / before)


def trend(change: Column, edge: float = 10.0) -> Column:
    return F.when(change > edge, "increasing").when(change < -edge, "decreasing").otherwise("stable")


def jumps(df: DataFrame, key: str, day: str, value: str, share: float = 0.2, gap_days: int = 3) -> DataFrame:
    """Rows whose value moved by more than `share` since the row before, at most `gap_days` earlier."""
    w = Window.partitionBy(key).orderBy(day)
    rows = df.withColumns({"before": F.lag(value).over(w), "day_before": F.lag(day).over(w)})
    moved = F.abs(F.col(value) - F.col("before")) > share * F.col("before")
    return rows.where((F.col("before") > 0) & moved & (F.datediff(day, "day_before") <= gap_days))


def pivot_flags(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """row x column presence; the values are named, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.bool_or(F.lit(True))).na.fill(False, list(values))


def flattened(schema: Mapping, prefix: str = "") -> list[Column]:
    """All leaves of nested structs as columns named by their path with `_`, in sorted order."""
    out: list[tuple[str, Column]] = []

    def walk(struct, path: list[str]) -> None:
        for f in struct.fields:
            at = [*path, f.name]
            if f.dataType.typeName() == "struct":
                walk(f.dataType, at)
            else:
                out.append(("_".join(at), F.col(".".join(f"`{p}`" for p in at))))

    walk(schema, [])
    return [c.alias(prefix + n) for n, c in sorted(out, key=lambda x: x[0])]
