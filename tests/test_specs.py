"""API descriptions: guards, references, bases and operations."""

import json

import pytest

from basalt.sources import specs

INFO = {"title": "t", "version": "1"}
BASE = {"openapi": "3.0.3", "info": INFO, "paths": {}}


def one(spark, body):
    looked = specs.looked_at(spark.createDataFrame([(1, body)], "spec_id long, body string"))
    return specs.verdicts(looked)


def chain(n, close=False):
    """References a0 -> a1 -> ... -> an, then to a definition or back to a1."""
    refs = {f"a{k}": {"$ref": f"#/c/a{k + 1}"} for k in range(n)}
    refs[f"a{n}"] = {"$ref": "#/c/a1"} if close else {"type": "string"}
    return {**BASE, "c": refs}


def deep(n):
    doc = {}
    for _ in range(n):
        doc = {"x": doc}
    return {**BASE, "y": doc}


CASES = [
    (BASE, None),
    ({**BASE, "openapi": "3.1.0", "paths": {}}, None),
    ({"openapi": "3.1.0", "info": INFO}, None),
    ({"swagger": "2.0", "info": INFO, "paths": {}}, None),
    ({"swagger": "1.2", "info": INFO, "paths": {}}, "unrecognized"),
    ({**BASE, "info": {"title": "t"}}, "no title or version"),
    ({"openapi": "3.0.0", "info": INFO}, "no paths"),
    ([1], "not an object"),
    ({**BASE, "c": [{"$ref": "other.json#/a"}]}, "external $ref"),
    ({**BASE, "c": {"$ref": 7}}, "external $ref"),
    ({**BASE, "c": {"$ref": "#/nowhere"}}, "unresolved $ref"),
    ({**BASE, "c": [{"$ref": "#/c/1"}, 3]}, None),
    ({**BASE, "c": {"a/b~": 1, "d": {"$ref": "#/c/a~1b~0"}}}, None),
    ({**BASE, "c": {"a": {"$ref": "#/c/a"}}}, "circular $ref"),
    ({**BASE, "c": {"a": {"p": {"$ref": "#/c/a"}}}}, None),  # a type that holds itself is no endless chain
    (chain(5), None),
    (chain(5, close=True), "circular $ref"),
    (chain(9), None),
    (deep(97), None),
    (deep(99), "too deep"),
    ({**BASE, "c": list(range(200_000))}, "too many nodes"),
    ({**BASE, "c": "x" * (5 << 20)}, "too large"),
]


@pytest.mark.parametrize("k", range(0, len(CASES), 6))
def test_guards(spark, k):
    some = CASES[k : k + 6]
    rows = spark.createDataFrame([(i, json.dumps(body)) for i, (body, _) in enumerate(some)], "spec_id long, body string")
    got = {r.spec_id: r.reason for r in specs.verdicts(specs.looked_at(rows)).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(some)}


def test_text_forms(spark):
    bodies = {None: "not an object", "": "not an object", "{": "not JSON or YAML", "openapi: 3.0.0\ninfo: {title: t, version: '1'}\npaths: {}": None, "a: &x [1]\nb: *x": "YAML anchor", "[" * 100_000: "too deep", "{" + '"a":{' * 3000 + "}" * 3001: "too deep"}
    for body, reason in bodies.items():
        assert one(spark, body).first().reason == reason, body and body[:40]


def test_bases_and_order(spark):
    paths = {"/z": {"put": {}, "parameters": [], "get": {}, "summary": "s"}, "/a": {"trace": {}, "GET": {}}, "/odd": 7, "/ref": {"$ref": "#/paths/~1z"}}
    servers = [{"url": "https://{h}.io/{v}/x", "variables": {"v": {"default": "v9"}, "h": {}}}, {"url": "/plain?q#f"}, {}, {"url": "//host.only"}]
    rows = [(1, json.dumps({**BASE, "paths": paths, "servers": servers})), (2, json.dumps({"swagger": "2.0", "info": INFO, "basePath": "/b", "paths": {"/p": {"post": {}}}})), (3, json.dumps({"swagger": "2.0", "info": INFO, "paths": {"/p": {"head": {}}}})), (4, json.dumps({**BASE, "servers": [], "paths": {"/n": {"patch": {}}}})), (None, '{"openapi":"3.0","info":{"title":"t","version":"1"},"paths":{"/d":{"get":{}},"/e":{"get":{}},"/d":{"put":{}}}}')]
    found = specs.documented(specs.verdicts(specs.looked_at(spark.createDataFrame(rows, "spec_id long, body string")))).orderBy("spec_id", "ord").collect()
    by = {}
    for r in found:
        by.setdefault(r.spec_id, []).append(r.operation)
    bases = ["/v9/x", "/plain", "", ""]
    assert by[1] == [f"{m} {b}{p}" for m, p in (("PUT", "/z"), ("GET", "/z"), ("TRACE", "/a")) for b in bases]
    assert (by[2], by[3], by[4]) == (["POST /b/p"], ["HEAD /p"], ["PATCH /n"])
    assert by[None] == ["PUT /d", "GET /e"]  # of equal keys the last counts, at the place of the first
    assert specs.documented(specs.verdicts(specs.looked_at(spark.createDataFrame([], "spec_id long, body string")))).count() == 0
