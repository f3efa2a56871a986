"""First candidates that resolve against a plain search; changes with a version check."""

import random

from basalt.operators import candidates, upserts

OCCURRENCE = "finding_hash string, source_path string, offset_start long, offset_end long, occurrence_hash string, input_ref string"


def test_first_that_resolves(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["f1", "f2", "f3", None, "hot", "hot", "hot"]), rng.choice([None, "a", "b"]), rng.choice([None, 0, 5, 9]), rng.choice([None, 7]), f"o{k:04}", rng.choice([None, "r1", *(f"gone{k % 50}" for _ in range(8))])) for k in range(500)]
    rows += [("none", "a", k, k + 1, f"n{k:03}", f"gone{k}") for k in range(40)] + [("last", "a", k, k + 1, f"l{k:03}", "r2" if k == 39 else "gone") for k in range(40)] + [("bare", "a", None, 1, "b", "r1")]
    blobs = spark.createDataFrame([("r1",), ("r2",), ("r2",), (None,)], "ref string")
    found, rounds = candidates.reveal_candidates(spark.createDataFrame(rows, OCCURRENCE).repartition(4), blobs)
    got = {r.finding_hash: (r.occurrence_hash, r.input_ref, r.resolved) for r in found.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2] is not None and r[3] is not None), key=lambda r: (r[1] or "", r[2], r[4]))
        good = [r for r in own if r[5] in ("r1", "r2")]
        if own:
            want[key] = (good[0][4], good[0][5], True) if good else (own[0][4], None, False)
    assert got == want and "bare" not in got
    assert rounds == 6 + (max(sum(r[0] == k and r[2] is not None and r[3] is not None for r in rows) for k in ("none", "last")) > 63)  # places 1, 2-3, 4-7, ... 32-63
    none, rounds = candidates.reveal_candidates(spark.createDataFrame([], OCCURRENCE), blobs)
    assert none.count() == 0 and rounds == 0


def test_versioned_changes(spark):
    current = spark.createDataFrame([("a", "x", 1, "b0"), ("b", "x", 2, "b0"), (None, "x", 1, "b0")], "k string, v string, version long, batch string")
    change = lambda rows: spark.createDataFrame(rows, "k string, v string, expected long, ord long, batch string")
    one = change([("a", "one", 1, 1, "b1"), ("a", "again", 1, 2, "b1"), ("b", "stale", 1, 3, "b1"), ("c", "new", None, 4, "b1"), (None, "null", 1, 5, "b1"), ("d", "missing", 1, 6, "b1")])
    two = change([("a", "two", 1, 1, "b2"), ("b", "two", 2, 2, "b2"), ("c", "two", 1, 3, "b2")])
    rows = lambda d: {r.k: (r.v, r.version, r.batch) for r in d.collect()}
    after = upserts.merged(current, one, ["k"], ["v"])
    want = {"a": ("one", 2, "b1"), "b": ("x", 2, "b0"), "c": ("new", 1, "b1"), None: ("null", 2, "b1")}
    assert rows(after) == want
    outcome = {(r.k, r.v): r.outcome for r in upserts.judged(current, one, ["k"], ["v"]).collect()}
    assert outcome == {("a", "one"): "applied", ("a", "again"): "conflict", ("b", "stale"): "conflict", ("c", "new"): "applied", (None, "null"): "applied", ("d", "missing"): "conflict"}
    assert rows(upserts.merged(after, one, ["k"], ["v"])) == want  # a replay
    # of two batches based on the same version one is applied
    both = upserts.merged(after, two, ["k"], ["v"])
    assert rows(both) == want | {"b": ("two", 3, "b2"), "c": ("two", 2, "b2")}
    assert {(r.k): r.outcome for r in upserts.judged(after, two, ["k"], ["v"]).collect()} == {"a": "conflict", "b": "applied", "c": "applied"}
    assert upserts.merged(current.limit(0), one.limit(0), ["k"], ["v"]).count() == 0
