"""Host inventories and artifacts against plain versions."""

import json
import random
import shlex
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from basalt.functions import artifacts
from basalt.operators import hosts


def test_six_sources(spark):
    rng = random.Random(3)
    names = ["a.io", "A.io.", "https://u:p@a.io:81/x", "b.io", None, "", "/rel", "c.io:9"]
    kinds = [*hosts.LANES, "secret", None]
    occurrences = [(rng.choice([1, 2]), rng.choice(kinds), rng.choice(names), f"f{rng.randrange(15)}") for _ in range(200)]
    assets = [(1, "http://a.io/x"), (1, "HTTPS://B.io/"), (1, "data:,x"), (1, "chrome://b.io"), (2, None), (1, "http://a.io/y")]
    technologies, declared = [(1, "a.io"), (1, "A.IO"), (2, "t.io")], [(1, "https://d.io/v1"), (2, "/v1"), (2, "a.io")]
    frame = spark.createDataFrame
    o = frame(occurrences, "run long, type string, host string, finding_hash string")
    out = hosts.inventory(frame(assets, "run long, url string"), o, frame(technologies, "run long, host string"), frame(declared, "run long, base_url string"), ["a.io"], [])
    got = {(r.run, r.host): (r.in_scope, r.declared, r.assets, r.endpoints, r.suspected, r.routes, r.techs) for r in out.collect()}
    host = {"a.io": "a.io", "A.io.": "a.io", "https://u:p@a.io:81/x": "a.io", "b.io": "b.io", "c.io:9": "c.io"}
    want = {}
    for run in (1, 2):
        per = {lane: {} for lane in ("endpoints", "suspected", "routes")}
        for r, kind, name, f in occurrences:
            if r == run and kind in hosts.LANES and host.get(name):
                per[hosts.LANES[kind]].setdefault(host[name], set()).add(f)
        web = {1: {"a.io": 2, "b.io": 1}, 2: {}}[run]
        tech = {1: {"a.io": 2}, 2: {"t.io": 1}}[run]
        said = {1: {"d.io"}, 2: {"a.io"}}[run]
        for h in {*web, *tech, *said, *(x for lane in per.values() for x in lane)}:
            want[run, h] = (h == "a.io", h in said, web.get(h, 0), *(len(per[lane].get(h, ())) for lane in per), tech.get(h, 0))
    assert got == want
    lost = {(r.run, r.lane): (r.findings, r.unattributed) for r in hosts.unattributed(o).collect()}
    for run in (1, 2):
        for lane in ("endpoints", "suspected", "routes"):
            own = [(name, f) for r, kind, name, f in occurrences if r == run and hosts.LANES.get(kind) == lane]
            assert lost[run, lane] == (len({f for _, f in own}), len({f for _, f in own} - {f for n, f in own if host.get(n)}))


def plain(operation, method, example, path, names, media, body):
    clean = lambda t: "".join(c for c in t if 0x20 <= ord(c) != 0x7F)[:8192]
    seen = clean(example or path)
    at = urlsplit(seen)
    first = clean(names[0]) if names else None
    if at.scheme and at.netloc:
        base, origin, host = f"{at.scheme}://{at.netloc}", (at.path or "/") + (f"?{at.query}" if at.query else ""), at.netloc
    else:
        base, origin, host = f"https://{first}" if first else "{{base_url}}", seen or "/", first or "HOST"
    data = json.dumps({n: f"<{n}>" for n in body}, separators=(",", ":")) if body else None
    url = (base + origin).replace("'", "'\\''")
    call = [f"curl -X {shlex.quote(clean(method))} '{url}'"]
    call += [f"  -H {shlex.quote('Content-Type: ' + clean(media))}"] if media else []
    call += [f"  --data {shlex.quote(data)}"] if data else []
    curl = [f"# {clean(operation)}" + (f"  (host: {first})" if names else "  (host unknown)"), "# add auth/headers here", " \\\n".join(call)]
    curl += ["# other hosts: " + ", ".join(map(clean, names[1:]))] if len(names) > 1 else []
    raw = [f"{clean(method)} {origin} HTTP/1.1", f"Host: {host}", "# add auth/headers here", *([f"Content-Type: {clean(media)}"] if media else []), "", data or ""]
    return "\n".join(curl), "\n".join(raw)


def test_artifacts(spark):
    rng = random.Random(9)
    rows = [(k, "GET /a\nb", rng.choice(["GET", "PO ST", "X'Y", "G\tT"]), rng.choice([None, "", "HTTPS://h.io:8/p?q=1#f", "http://h.io", "/rel?x='y'", "h.io/p", "https://h.io/a'b\r\nEvil: 1"]), rng.choice(["/p/{id}", ""]), rng.choice([[], ["a.io"], ["a.io", "b.io\n", "c.io"]]), rng.choice([None, "", "application/json", "x y"]), rng.choice([None, [], ["n"], ["a\"b", "c'd", "n", "n"]])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, operation string, method string, example string, path string, hosts array<string>, media string, body array<string>")
    given = [F.col(c) for c in ("example", "path", "hosts", "media", "body")]
    got = {r.id: (r.c, r.h) for r in df.select("id", artifacts.curl(F.col("operation"), F.col("method"), *given).alias("c"), artifacts.raw_http(F.col("method"), *given).alias("h")).collect()}
    for k, *rest in rows:
        assert got[k] == plain(*rest), rest
