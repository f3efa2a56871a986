"""Streams end with the rows of their batch twins."""

import pytest
from pyspark.sql import functions as F

from basalt.streaming import events


@pytest.fixture
def feed(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).alias("key"), (F.timestamp_seconds(F.col("id") * 7)).alias("ts"), F.concat(F.lit("c"), (F.col("id") % 60).cast("string")).alias("content"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), tmp_path


def drained(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_budget(feed):
    batch, stream, path = feed
    make = lambda d: events.over_budget(d, "ts", ["key"], "1 minute", 1)
    got, want = rows(drained(make(stream), path, "budget", "update")), rows(make(batch))
    assert got == want and want


def test_dedupe(feed):
    batch, stream, path = feed
    make = lambda d: events.deduped(d, "ts", "content").select("content")
    assert rows(drained(make(stream), path, "dedupe")) == rows(make(batch))


def test_run_states(spark, tmp_path):
    log = [(1, 1, "queued"), (1, 2, "running"), (1, 3, "queued"), (1, 4, "done"), (1, 5, "running"), (2, 1, "running"), (2, 2, "paused"), (2, 3, "running")]
    spark.createDataFrame(log, "run long, seq long, event string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run long, seq long, event string").parquet(str(tmp_path / "in"))
    assert rows(drained(events.run_states(stream, "run", "seq", "event"), tmp_path, "states", "update")) == [(1, "done"), (2, "running")]


def test_fold_twin():
    assert events.fold_state(None, ["running", "queued", "failed", "done"]) == "failed"


def test_throttle(feed):
    batch, stream, path = feed
    make = lambda d: events.throttled(d, "ts", "key", "40 seconds", 3)
    got, want = rows(drained(make(stream), path, "throttle")), rows(make(batch))
    # a session that the watermark hasn't passed is still open on the stream
    assert want and set(got) <= set(want)


def test_context_join(feed):
    batch, stream, path = feed
    # a row at the epoch is late for a new stream, whose watermark starts there
    half = lambda d, k: d.where(f"unix_seconds(ts) > 0 AND unix_seconds(ts) % 2 = {k}")
    make = lambda d: events.context_join(half(d, 0), half(d, 1), "key", "40 seconds")
    got, want = rows(drained(make(stream), path, "context")), rows(make(batch))
    assert got == want and want


def test_batch_dedupe_keeps_the_first(spark):
    given = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "t int, c string").select(F.timestamp_seconds("t").alias("ts"), "c", F.col("t"))
    assert sorted((r.t, r.c) for r in events.deduped(given, "ts", "c").collect()) == [(1, "a"), (2, "b")]
