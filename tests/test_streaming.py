import os

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import counters

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('events')}/in"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(path)
    return path


def finished(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_tumbling_equals_batch(spark, folder):
    got = finished(counters.tumbling(counters.events(spark, folder), "1 day"), "complete", "daily")
    batch = counters.tumbling(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    key = lambda df: {(r.window.start, r.n, r.n_4xx, r.n_5xx, r.latency) for r in df.collect()}
    assert key(got) == key(batch) and got.count() > 1


def test_rate_limit_opens_a_window_per_user(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1) for i in range(5)] + [(9, "2024-01-01 00:01:30", 1), (10, "2024-01-01 00:00:00", 2)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    path = f"file://{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    got = finished(counters.limited(counters.events(spark, path), 3), "append", "limits")
    assert {(r.event_id, r.allowed) for r in got.collect()} == {(0, True), (1, True), (2, True), (3, False), (4, False), (9, True), (10, True)}


def test_poll_is_incremental(spark, folder, tmp_path):
    seen = []
    for _ in range(2):
        counters.poll(counters.once(counters.events(spark, folder)), f"file://{tmp_path}/cp", lambda df, _: seen.append(df.count()))
    assert sum(seen) == spark.read.parquet(folder).count()


def arrivals(spark, path, batches):
    """A file for each batch, older ones first."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(e, t, u) for e, t, u in rows], "event_id long, t string, user_id long")
        df = df.select("event_id", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("batch"):
                os.rename(f"{path}/{f}", f"{path}/batch{k}.parquet")
                os.utime(f"{path}/batch{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def by_batch(spark, path, late, name, make):
    """What the stream gives, a file a batch, and the rows of state after each batch."""
    rows = spark.readStream.schema(counters.EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    q = make(rows).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.user_id, r.event_id): r.allowed for r in spark.table(name).collect()}, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


BATCHES = [
    [(1, "00:00:00", 1), (2, "00:00:10", 1), (3, "00:00:05", 2)],
    [(4, "00:00:40", 1), (5, "00:00:20", 1)],  # 5 comes late, before 4
    [(6, "00:10:00", 3), (7, "00:10:00", 3)],  # users 1 and 2 idle: their windows end
    [(8, "00:10:30", 1), (9, "00:00:01", 2), (10, "00:20:00", 4)],  # 9 is older than the watermark
]


def test_rate_limit_state_ends_with_the_window(spark, tmp_path):
    path = f"{tmp_path}/in"
    arrivals(spark, path, BATCHES)
    got, state = by_batch(spark, path, "30 seconds", "limits_now", lambda df: counters.limited(df, 2))
    assert got == {(1, 1): True, (1, 2): True, (2, 3): True, (1, 4): False, (1, 5): False, (3, 6): True, (3, 7): True, (1, 8): True, (4, 10): True} | {k: v for k, v in got.items() if k == (2, 9)}
    assert max(state) >= 2
    assert state[-1] <= 1  # users 1 to 3 are gone


def test_rate_limit_in_order_of_events(spark, tmp_path):
    path = f"{tmp_path}/in"
    arrivals(spark, path, BATCHES)
    got, state = by_batch(spark, path, "30 seconds", "limits_ordered", lambda df: counters.limited(df, 3, ordered=True))
    assert got[1, 5] is True  # third by time, though it came fourth
    assert got[1, 4] is False
    assert (4, 10) not in got  # the watermark hasn't passed it
    assert got[3, 6] is got[3, 7] is True


def test_once_within_the_watermark(spark, tmp_path):
    path = f"{tmp_path}/in"
    arrivals(spark, path, [[(1, "00:00:00", 1), (1, "00:00:01", 1)], [(1, "00:00:02", 1), (2, "00:05:00", 1)], [(2, "00:05:00", 1), (3, "00:30:00", 1)]])
    rows = spark.readStream.schema(counters.EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    q = counters.once(rows).select("event_id").writeStream.format("memory").queryName("once_each").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once_each").collect()) == [1, 2, 3]


def test_late_rows_fall_out_of_closed_windows(spark, tmp_path):
    path = f"{tmp_path}/in"
    arrivals(spark, path, [[(1, "00:00:10", 1)], [(2, "01:00:00", 1)], [(5, "01:10:00", 1)], [(3, "00:00:20", 1), (4, "02:00:00", 1)]])
    rows = spark.readStream.schema(counters.EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "5 minutes")
    q = rows.groupBy(F.window("ts", "1 minute")).count().writeStream.outputMode("append").format("memory").queryName("late_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("late_rows").collect()) == [1, 1, 1]
    assert sum(int(p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in q.recentProgress) == 1
