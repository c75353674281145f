"""Documents refreshed where their rows changed: a digest per company tells which are to be built anew."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import written


def digests(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(company_id, digest) over the rows of all tables (frame, name of its company column), whatever their order: of each table the number
    of rows, and the sum and the exclusive or of their hashes. Rows that repeat count; rows without a company don't."""
    parts = []
    for name, (df, company) in sorted(tables.items()):
        row = [F.xxhash64(F.lit(seed), F.lit(name), *[F.to_json(F.struct(F.col(f"`{c}`").alias("x")), {"ignoreNullFields": "false"}) for c in sorted(df.columns)]) for seed in (1, 2)]
        parts.append(df.where(F.col(company).isNotNull()).select(F.col(company).alias("company_id"), row[0].alias("a"), row[1].alias("b")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"))
    return sums.select("company_id", F.concat_ws(":", "n", "x", "s").alias("digest"))


def refreshed(stored: DataFrame, tables: dict[str, tuple[DataFrame, str]], build: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """(company_id, document, digest, rebuilt): the stored documents (company_id, document, digest) where the digest is still the same, new ones where
    it isn't; companies that are gone leave. `build` gets the tables with the rows of changed companies only and returns (company_id,
    document). The result equals a full build; write it to a new place, for it reads the stored rows."""
    now = written(digests(tables), "digests")
    same = stored.select("company_id", "document", "digest").join(now, ["company_id", "digest"], "left_semi")
    changed = written(now.join(same.select("company_id"), "company_id", "left_anti"), "changed")
    some = {name: df.join(changed.select(F.col("company_id").alias(company)), company, "left_semi") for name, (df, company) in tables.items()}
    fresh = build(some).join(changed, "company_id").select("company_id", "document", "digest", F.lit(True).alias("rebuilt"))
    return fresh.unionByName(same.withColumn("rebuilt", F.lit(False)))
