"""Recording findings and places: any batches give what one plain pass gives."""

import hashlib
import json
import random

from basalt.functions import identity
from basalt.operators import records
from pyspark.sql import functions as F

SCHEMA = "run_id long, finding_hash string, ord long, type string, value string, path string, severity string, first_stage string, auth array<struct<name: string, scheme: string>>, risk_tags array<string>, kind string, has_kind boolean, wrapper string, raw_url string, host string, source_path string, offset_start long, offset_end long, line long, col long, asset_url string, evidence string, engine string, confidence string, verified boolean"
TEXTS = [None, "", "plain", 'quote " and \\', "tab\tline\n\r\x08\x0c\x01\x7f", "é中", "\U0001f600 x", "a" * 3000 + "é"]


def rows(rng, n):
    out = []
    for k in range(n):
        has_kind = rng.random() < 0.6
        auth = rng.choice([None, [], [("Authorization", "bearer")], [("X-A", None), ("Authorization", "basic")], [("X-A", None)]])
        out.append((rng.choice([1, 2, None]), rng.choice(["hot", "hot", "f1", "f2", "f3"]), k, "endpoint", f"v{k % 4}", rng.choice([None, "a", "b"]), rng.choice([None, "low"]), "s", auth, rng.choice([None, [], ["b", "a"], ["c"]]), rng.choice(["fetch", "xhr", None]) if has_kind else None, has_kind, rng.choice([None, None, "w1", "w2"]),
                    rng.choice(TEXTS), rng.choice([None, "h"]), rng.choice(TEXTS[:4]), rng.choice([None, 0, 5]), rng.choice([None, 9]), rng.choice([None, 1]), None, rng.choice([None, "u"]), f"e{k}", "static", "certain", rng.choice([None, True, False])))
    return out


def plain(data):
    found, places = {}, {}
    for r in data:
        key = (r[0], r[1])
        f = found.setdefault(key, {"path": r[5], "severity": r[6], "auth": [], "tags": set(), "kinds": [], "wrapper": None})
        f["auth"] += [tuple(a) for a in r[8] or [] if tuple(a) not in f["auth"]]
        f["tags"] |= set(r[9] or [])
        f["kinds"] += [r[10]] if r[11] else []
        f["wrapper"] = f["wrapper"] if f["wrapper"] is not None else r[12]
        fields = dict(zip(records.PLACE, r[13:21], strict=True))
        places.setdefault((*key, hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()), r[21])
    return {k: (f["path"], f["severity"], f["auth"], sorted(f["tags"]), f["kinds"][0] if len(set(f["kinds"])) == 1 else None, f["wrapper"]) for k, f in found.items()}, places


def got(found, places):
    return (
        {(r.run_id, r.finding_hash): (r.path, r.severity, [tuple(a) for a in r.auth], r.risk_tags, r.kind, r.wrapper) for r in found.collect()},
        {(r.run_id, r.finding_hash, r.occurrence_hash): r.evidence for r in places.collect()},
    )


def test_batches_equal_one_pass(spark):
    data = rows(random.Random(4), 400)
    whole = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert got(records.findings(whole), records.places(whole)) == plain(data)
    found = places = None
    for a, b in ((0, 30), (30, 200), (30, 200), (200, 400), (0, 400)):  # some come again
        part = spark.createDataFrame(data[a:b], SCHEMA).repartition(3)
        found, places = records.findings(part, found).cache(), records.places(part, places).cache()
    assert got(found, places) == plain(data)
    none = spark.createDataFrame([], SCHEMA)
    assert got(records.findings(none), records.places(none)) == ({}, {})
    assert got(records.findings(none, found), records.places(none, places)) == plain(data)


def test_hash_is_that_of_the_json(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    for r in texts.select("k", "t", identity.json_hash(b=F.col("t"), a=F.col("k")).alias("h")).collect():
        assert r.h == hashlib.sha256(json.dumps({"a": r.k, "b": r.t}, separators=(",", ":")).encode()).hexdigest(), r


def test_findings_of_files(spark):
    rng = random.Random(6)
    seen = [(rng.choice(["f1", "f2", "f3", "f4", "f5", None]), rng.choice(["input.js", "a", "b", None]), rng.choice([None, "u1", "u2"])) for _ in range(60)]
    files = [("asset", "u1", None), ("asset", "u1", "x"), ("asset", "u9", None), ("source", "a", "u1"), ("source", "a", "u2"), ("source", "b", None), ("upload", "bundle", None), ("upload", "a", None), ("asset", "a", None)]
    for some in (seen, [s for s in seen if s[1] != "input.js"], []):
        want = {}
        for kind, path, asset in files:
            for h, source, own in some:
                if (own == path if kind == "asset" else source == path and own == asset if kind == "source" else source == "input.js" and own is None):
                    want.setdefault(path, set()).add(h)
        out = records.file_findings(spark.createDataFrame(files, "kind string, path string, asset_url string"), spark.createDataFrame(some, "finding_hash string, source_path string, asset_url string"))
        assert {r.path: r.findings for r in out.collect()} == {p: len(h - {None}) for p, h in want.items() if h - {None}}


def test_coverage_and_files(spark):
    kind = "run_id long, id long, attributed long, unattributed long, secrets long, secrets_engine string, sources_recovered long, source_map string, files array<struct<path: string, attributed: long, unattributed: long>>"
    events = [(1, 5, 1, None, 2, "ok", 0, "inline", [("a", 1, 2), ("a", 1, None)]), (1, 9, 4, 4, 0, "unavailable", 3, None, []), (1, 7, 1, 1, 1, None, 1, "x", [(None, None, 3)]), (2, 1, None, None, None, None, None, None, None), (None, 3, 1, 1, 1, "ok", 1, "m", [("z", 1, 1)])]
    df = spark.createDataFrame(events, kind).repartition(3)
    assert {r.run_id: tuple(r)[1:] for r in records.run_coverage(df).collect()} == {1: (6, 5, 3, "unavailable", 4, "none", 3), 2: (0, 0, 0, "ok", 0, "none", 0), None: (1, 1, 1, "ok", 1, "m", 1)}
    assert sorted((str(r.run_id), r.place, r.path, r.attributed, r.unattributed) for r in records.run_files(df).collect()) == [("1", 1, "", 0, 3), ("1", 2, "a", 1, 2), ("1", 3, "a", 1, 0), ("None", 1, "z", 1, 1)]
    assert records.run_files(df.limit(0)).count() == records.run_coverage(df.limit(0)).count() == 0
