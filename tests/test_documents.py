"""The document of a run against a plain merge of its requests."""

import json
import random
import re

from basalt.operators import documents as D
from basalt.sources import specs

SCHEMA = "run string, ord long, method string, path string, hosts array<string>, query array<struct<name: string, example: string>>, body array<string>, content_type string, example_url string, probeable boolean, auth array<struct<name: string, scheme: string>>"


def plain_operation(group, path):
    """group: requests of one operation in order, with the kinds of their path parameters."""
    params = {}
    for r, kinds in group:
        for name, kind in kinds:
            params.setdefault((name, "path"), {"name": name, "in": "path", "required": True, "schema": {"integer": {"type": "integer"}, "uuid": {"type": "string", "format": "uuid"}}.get(kind, {"type": "string"}), "description": D.SYNTHETIC})
        for q in r["query"] or []:
            params.setdefault((q[0], "query"), {"name": q[0], "in": "query", "required": False, "schema": {"type": "string"}, "description": D.INFERRED} | ({"example": q[1]} if q[1] is not None else {}))
    names = [n for r, _ in group for n in r["body"] or []]
    names = sorted(set(names)) if len(group) > 1 else list(dict.fromkeys(names))
    types = sorted({r["content_type"] for r, _ in group if r["body"] and r["content_type"]})
    out = {"x-basalt-confidence": {"path": "certain", "methods": "observed-only", "param-names": "synthesized" if "{" in path else "observed", "param-types": "inferred", "body": "absent" if not names else "inferred" if types else "names-only"}, "responses": {"default": {"description": D.RESPONSE}}}
    if params:
        out["parameters"] = list(params.values())
    if names and types:
        out["requestBody"] = {"required": False, "content": {t: {"schema": {"type": "object", "description": D.BODY, "properties": {n: {"type": "string", "description": D.INFERRED} for n in names}}} for t in types}}
    elif names:
        out["x-basalt-body-params"] = names
        out["description"] = f"A body with these names was seen: {', '.join(names)}; its media type was not."
    risky = {"userId": ["idor"], "password": ["auth"], "isAdmin": ["admin"]}
    seen = {n for r, _ in group for n in [*(q[0] for q in r["query"] or []), *(r["body"] or [])]}
    if seen & set(risky):
        out["x-basalt-risk"] = {n: t for n, t in risky.items() if n in seen}
    keys = sorted({key_of(*a) for r, _ in group for a in r["auth"] or []})
    if keys:
        out["security"] = [{k: [] for k in keys}]
    return out


def key_of(name, scheme):
    return f"{scheme}Auth" if name.lower() == "authorization" and scheme in ("bearer", "basic") else re.sub("[^A-Za-z0-9._-]", "_", name) or "auth"


PATHS = {"/a": ("/a", []), "/a/{id}": ("/a/{id}", [("id", "integer")]), "/a/${id}": ("/a/{id}", [("id", "string")]), "/b/{uuid}/{uuid}": ("/b/{uuid}/{uuid2}", [("uuid", "uuid"), ("uuid2", "uuid")]), "/c/x${y}": ("/c/{p1}", [("p1", "string")])}


def test_document_is_the_plain_merge(spark):
    rng = random.Random(11)
    rows = []
    for k in range(160):
        method = rng.choice(["GET", "GET", "POST", "PATCH", "PURGE", "WS"])
        query = [(rng.choice(["q", "userId", "page\"x"]), rng.choice([None, "1"])) for _ in range(rng.randrange(3))]
        body = list(dict.fromkeys(rng.choice(["name", "password", "isAdmin", "z"]) for _ in range(rng.randrange(3)))) if method in ("POST", "PATCH") else rng.choice([[], None])
        auth = [rng.choice([("Authorization", "bearer"), ("authorization", None), ("X-Key", "bearer"), ("", None)]) for _ in range(rng.randrange(2))]
        rows.append((rng.choice(["run-one-long", "two", None]), k, method, rng.choice(list(PATHS)), rng.choice([[], ["h.io"], ["g.io", "h.io"]]), query, body, rng.choice([None, "application/json", "text/plain"]), rng.choice([None, "", "http://h.io:81/x", "https://[::1]/y", "/rel"]), method != "WS", auth))
    rows.append(("empty", 999, "WS", "/s", [], None, None, None, None, False, None))
    got = {r.run: json.loads(r.document) for r in D.documents(spark.createDataFrame(rows, SCHEMA), graphql=spark.createDataFrame([("two", "query", "Q"), ("two", "query", "Q")], "run string, kind string, name string")).collect()}
    names = [f.split(" ")[0] for f in ("run ord method path hosts query body content_type example_url probeable auth").split()]
    by_run = {}
    for row in rows:
        by_run.setdefault(row[0], []).append(dict(zip(names, row, strict=True)))
    assert set(got) == set(by_run)
    for run, own in by_run.items():
        groups, origins, others, sockets, schemes = {}, {}, set(), set(), {}
        for r in own:
            if not r["probeable"]:
                sockets.add(f"{r['method']} {r['example_url'] or r['path']}")
                continue
            m = re.match(r"(\w+)://(\[.*?\]|[^/:]*)(:\d+)?", r["example_url"] or "")
            if m:
                origins[m[2].strip("[]")] = m[0]
            for h in r["hosts"]:
                origins.setdefault(h, f"https://{h}")
            if r["method"] == "PURGE":
                others.add(f"PURGE {r['example_url'] or r['path']}")
                continue
            path, kinds = PATHS[r["path"]]
            groups.setdefault((path, r["method"].lower()), []).append((r, kinds))
            for name, scheme in r["auth"] or []:
                http = key_of(name, scheme) in ("bearerAuth", "basicAuth")
                schemes.setdefault(key_of(name, scheme), {"type": "http", "scheme": scheme} if http else {"type": "apiKey", "in": "header", "name": name})
        doc = got[run]
        for (p, m), g in groups.items():
            assert doc["paths"][p][m] == plain_operation(g, p)
        assert {(p, m) for p, item in doc["paths"].items() for m in item} == set(groups)
        assert list(doc["paths"]) == list(dict.fromkeys(p for p, _ in groups))
        assert [s["url"] for s in doc.get("servers", [])] == sorted(set(origins.values()))
        assert doc.get("x-basalt-websocket-endpoints", []) == sorted(sockets) and doc.get("x-basalt-other-operations", []) == sorted(others)
        assert doc.get("components", {}).get("securitySchemes", {}) == schemes
    assert got["two"]["x-basalt-graphql-operations"] == [{"kind": "query", "name": "Q"}]
    assert D.documents(spark.createDataFrame([], SCHEMA)).count() == 0
    # what is written is read again as a description
    texts = spark.createDataFrame([(k or "none", json.dumps(d)) for k, d in got.items()], "spec_id string, body string")
    assert {r.reason for r in specs.verdicts(specs.looked_at(texts)).collect()} == {None}
