"""Streams with timers give the rows of their batch twins, whatever the order of arrival, and let their state go."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.streaming import events, keyed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def stores(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def fed(spark, tmp_path, batches, schema, made, name):
    """The rows of a stream that gets the batches one after the other, and the state rows it has left."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
    shape = spark.read.parquet(str(tmp_path / "in")).drop("b").schema
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    return sorted(map(tuple, spark.table(name).collect())), left


def plain_single_use(rows, limit):
    held, out = {}, []
    for t, key, kind, seq, host in sorted(rows, key=lambda r: (r[1], r[0], keyed.KINDS.index(r[2]), r[3])):
        if kind == "context":
            held[key] = (t, seq, host)
        elif key in held:
            at, first, name = held.pop(key)
            if kind == "completion" and t - at <= limit and keyed.below(host, name):
                out.append((key, first, seq, at * 1_000_000, t * 1_000_000))
    return sorted(out)


def test_single_use(stores, tmp_path):
    rng = random.Random(5)
    hosts = ["a.io", "x.a.io", "b.io", "", None]
    rows = [(100 + rng.randrange(400), f"k{rng.randrange(9)}", rng.choice(["context", "context", "completion", "completion", "discard"]), k, rng.choice(hosts[:2] if k % 3 else hosts)) for k in range(300)]
    schema = "t long, key string, kind string, seq long, host string"
    frame = stores.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    want = plain_single_use(rows, 30)
    assert sorted(map(tuple, keyed.single_use(frame, "key", 30).collect())) == want and len(want) > 10
    # by time, but each row up to 50 s out of order, in three batches; at last rows that push the watermark on
    mixed = sorted(rows, key=lambda r: r[0] + rng.random() * 50)
    batches = [mixed[:100], mixed[100:200], mixed[200:], [(5000, "end", "discard", 900, "")], [(9000, "end", "discard", 901, "")]]
    got, left = fed(stores, tmp_path, batches, schema, lambda s: keyed.single_use(s, "key", 30, "5 minutes"), "single_use")
    assert got == want
    assert left <= 4  # of the last key alone


def plain_waits(rows, gap):
    last, out = {}, []
    for t, host, seq in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        wait = max(0, last[host] + gap - t) if host in last else 0
        if not wait:
            last[host] = t
        out.append((host, seq, t * 1_000_000, wait * 1_000_000))
    return sorted(out)


def test_host_gap(stores, tmp_path):
    rng = random.Random(6)
    rows = [(100 + rng.randrange(200), rng.choice(["a", "b", "c"]), k) for k in range(150)]
    schema = "t long, host string, seq long"
    frame = stores.createDataFrame([*rows, (1, None, 7)], schema).withColumn("ts", F.timestamp_seconds("t"))
    want = plain_waits(rows, 7)
    assert sorted(map(tuple, keyed.host_waits(frame, "host", 7).collect())) == want and any(w[3] for w in want)
    mixed = sorted(rows, key=lambda r: r[0] + rng.random() * 30)
    batches = [mixed[:80], mixed[80:], [(5000, "end", 900)], [(9000, "end", 901)]]
    got, left = fed(stores, tmp_path, batches, schema, lambda s: keyed.host_waits(s, "host", 7, "2 minutes"), "host_gap")
    assert [r for r in got if r[0] != "end"] == want
    assert left <= 4
    by_second = {}
    for r in keyed.fetch_waits(frame, "host", 0, 2).collect():
        by_second.setdefault(r["at"], []).append(r.why)
    assert all(w.count("none") == min(2, len(w)) for w in by_second.values())


def test_run_states_expire(stores, tmp_path):
    log = [(10, 1, 1, "queued"), (20, 1, 2, "running"), (30, 1, 3, "queued"), (40, 1, 4, "done"), (50, 1, 5, "running"), (15, 2, 6, "paused"), (16, 2, 7, "running"), (17, 3, 8, "nothing")]
    schema = "t long, run long, seq long, state string"
    mixed = [log[3], log[0], log[5], log[1], log[7], log[2], log[6], log[4]]
    got, left = fed(stores, tmp_path, [mixed, [(5000, 9, 9, "x")], [(9000, 9, 10, "x")]], schema, lambda s: keyed.run_transitions(s, "run", 60, "2 minutes"), "run_changes")
    last = {}
    for run, _, state in sorted(got, key=lambda r: r[1]):
        last.setdefault(run, []).append(state)
    assert last == {1: ["queued", "running", "done"], 2: ["paused", "running"]}
    assert left <= 4
    assert events.fold_state(None, ["queued", "running", "queued", "done", "running"]) == last[1][-1]
