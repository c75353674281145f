"""Event-time counters on Structured Streaming, each with its batch twin where one exists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.names import latency_bucket

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, late: str = "48 hours", pattern: str = "*.parquet") -> DataFrame:
    """A file stream of events with zoned time and a watermark."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def request_facts(df: DataFrame) -> DataFrame:
    """Events read as requests: status and latency from the id, as the usage view has them."""
    status = F.when(F.col("event_id") % 20 == 0, 500).when(F.col("event_id") % 9 == 0, 404).otherwise(200)
    return df.withColumns({"status": status, "latency_ms": (F.col("event_id") % 100).cast("int")})


def tumbling(df: DataFrame, size: str, *by: str) -> DataFrame:
    """Counts per window: total, errors by class, latency; `by` splits them further."""
    rows = request_facts(df)
    return rows.groupBy(F.window("ts", size), *by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") >= 400) & (F.col("status") < 500)).alias("n_4xx"), F.count_if(F.col("status") >= 500).alias("n_5xx"),
        F.sum("latency_ms").alias("latency"), F.approx_count_distinct("user_id").alias("clients"),
    )


def by_latency(df: DataFrame, size: str = "1 hour") -> DataFrame:
    return request_facts(df).groupBy(F.window("ts", size), latency_bucket(F.col("latency_ms")).alias("bucket")).count()


def alerts(counts: DataFrame, least: int = 10) -> DataFrame:
    share = F.col("n_5xx") * 100.0 / F.col("n")
    return counts.where(F.col("n") > least).withColumn("alert", F.when(share > 10, "critical").when(share > 5, "warning")).where("alert is not null")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(F.session_window("ts", gap), "user_id").count()


def once(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the watermark."""
    return df.dropDuplicatesWithinWatermark([key])


def limited(df: DataFrame, most: int, seconds: int = 60, ordered: bool = False) -> DataFrame:
    """(user_id, event_id, allowed): a fixed window per user, opened by its first event, of `most` events.

    Events of a batch are taken by time and id. Across batches they count as they arrive; `ordered` holds each back until
    the watermark has passed it, so that late rows within the watermark take their place, and decides nothing before. A user's state
    goes when the watermark passes the end of its window and nothing waits. The stream needs a watermark on `ts`.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used, held = state.get if state.exists else (None, 0, [])
        waiting = list(zip(held[::2], held[1::2], strict=True))  # times in milliseconds, and ids
        for frame in [] if state.hasTimedOut else frames:
            waiting += zip(frame["at"], frame["event_id"], strict=True)
        reached = state.getCurrentWatermarkMs()
        waiting.sort()
        due = [w for w in waiting if not ordered or w[0] < reached]
        out = []
        for at, event in due:
            if opened is None or at >= opened + seconds * 1000:
                opened, used = int(at), 0
            used += 1
            out.append((key[0], event, used <= most))
        waiting = waiting[len(due) :]
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])
        closes = opened + seconds * 1000 if opened is not None else 0
        if waiting or closes > reached:
            state.update((opened, used, [int(x) for w in waiting for x in w]))
            state.setTimeoutTimestamp(max(reached + 1, int(min([w[0] + 1 for w in waiting] or [closes]))))
        elif state.exists:
            state.remove()

    keyed = df.select("user_id", "event_id", F.unix_millis("ts").alias("at"), "ts")
    kinds = "user_id long, event_id long, allowed boolean", "opened long, used long, waiting array<long>"
    return keyed.groupBy("user_id").applyInPandasWithState(work, *kinds, "append", GroupStateTimeout.EventTimeTimeout)


def poll(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Work off what is there, batch by batch, from where the last run ended."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
