"""Places and running sums over whole tables; files out of source maps."""

import json
import random

from pyspark.sql import functions as F

from basalt.operators import ranks
from basalt.sources import source_maps


def test_places_and_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(90)]), k, rng.choice([None, 1, 5, 100])) for k in range(700)]
    df = spark.createDataFrame(rows, "key string, at long, id long, size long").repartition(6)
    for parts in (1, 3, 16):
        got = {r.id: (r.place, r.total) for r in ranks.ranked(df, ["key"], ["at", "id"], {"total": "size"}, parts=parts).collect()}
        want, place, total = {}, {}, {}
        for key, _, k, size in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            place[key] = place.get(key, 0) + 1
            total[key] = total.get(key, 0) + (size or 0)
            want[k] = (place[key], total[key])
        assert got == want
    whole = ranks.ranked(df, [], ["id"], parts=5)
    assert sorted((r.id, r.place) for r in whole.collect()) == [(k, k + 1) for k in range(700)]
    assert ranks.ranked(df.limit(0), ["key"], ["at"]).count() == 0


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(4000).select(F.lit("hot").alias("key"), "id")
    out = ranks.ranked(df, ["key"], ["id"], parts=8)
    assert out.agg(F.max("place")).first()[0] == 4000
    # the only window over the whole key is over one row for each partition
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("_part" in line.split("],")[1] for line in windows) >= 1


def test_walk(spark):
    sources = ["b.js", "z/a.js", "webpack:///./a/../c.js?x", "../../up.js", "z/y/n.js", "z/b.js", None, "", "..", "b.js"]
    contents = [f"{k}é" for k in range(len(sources) - 1)] + ["last"]
    text = json.dumps({"sources": sources, "sourcesContent": contents})
    rows = spark.createDataFrame([(1, text), (2, "no map"), (3, None), (4, json.dumps({"sources": ["a"], "sourcesContent": []})), (5, json.dumps({"sourceRoot": "/r/", "sources": ["a"], "sourcesContent": ["x"]}))], "id long, map string")
    got = [(r.id, r.path, r.content) for r in source_maps.recovered(rows, "id", "map").withColumn("w", source_maps.walk_order(F.col("path"))).orderBy("id", "w").collect()]
    assert got == [(1, "b.js", "last"), (1, "c.js", "2é"), (1, "up.js", "3é"), (1, "z/a.js", "1é"), (1, "z/b.js", "5é"), (1, "z/y/n.js", "4é"), (5, "r/a", "x")]
    some = source_maps.recovered(rows, "id", "map", most_bytes=10).collect()
    assert sorted(r.path for r in some) == ["b.js", "c.js", "r/a", "up.js"]
