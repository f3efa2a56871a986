"""Small tables with known results."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.functions import identity, scope, text, urls
from basalt.operators import correlate, findings, intervals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("segment", "expected"),
    [("4821", "{id}"), ("a1b2c3d4e5f60718", "{hash}"), ("v1", "v1"), ("acme-corporation-holdings-emea", "acme-corporation-holdings-emea"), ("aZ9kQ2mB7xL4wP0rT6uY1eC5", "{hash}")],
)
def test_template_segment(spark, segment, expected):
    assert one(spark, urls.template_segment(F.lit(segment))) == expected


@pytest.mark.parametrize(
    ("method", "url", "value", "host"),
    [
        ("post", "https://API.acme.io:443/users/4821/orders/f47ac10b-58cc-4372-a567-0e02b2c3d479?sort=asc&page=2&sort=desc", "POST /users/{id}/orders/{uuid}?page&sort", "api.acme.io"),
        ("GET", "/search?ids[]=1&ids[]=2&q=hi", "GET /search?ids&q", None),
        ("WSS", "wss://rt.acme.io/socket/42", "WSS /socket/{id}", "rt.acme.io"),
    ],
)
def test_endpoint(spark, method, url, value, host):
    x = one(spark, urls.endpoint(F.lit(method), F.lit(url)))
    assert (x["value"], x["host"]) == (value, host)


def test_finding_hash(spark):
    want = "e6bca99690ea97c2e4cfd62d8a47aedb5ca624acb193385c23220ffa5f3f6fa7"
    assert one(spark, identity.plain_finding_hash(F.lit("endpoint"), F.lit("GET /users/{id}"))) == want
    rows = spark.createDataFrame([("endpoint", "GET /users/{id}"), ("endpoint", "GET /é"), (None, "x")], "k string, v string")
    got = [r.h for r in rows.select(identity.finding_hash(F.col("k"), F.col("v")).alias("h")).collect()]
    assert got[0] == want and len(got[1]) == 64 and got[2] is None


def test_scope(spark):
    inside = lambda h: one(spark, scope.in_scope(F.lit(h), ["*.acme.io", "com"], ["com"]))
    assert inside("a.ACME.io.") and inside("acme.io") and not inside("notacme.io") and not inside("x.com")


def test_classify_equals_all_pairs(spark):
    rng = random.Random(1)
    path = lambda: "/" + "/".join(rng.choice(["a", "b", "{x}", "7", "c"]) for _ in range(rng.randint(0, 3)))
    ops = sorted({f"{rng.choice(['GET', 'PUT', 'WS'])} {path()}" for _ in range(60)})
    docs = [(k, f"{rng.choice(['GET', 'PUT'])} {path()}") for k in range(25)]
    got = {r.operation: (r.reason, r.matched) for r in correlate.classify(spark.createDataFrame([(o,) for o in ops], "operation string"), spark.createDataFrame(docs, "ord int, operation string")).collect()}
    split = lambda o: (o.split(" ")[0], tuple("*" if s == "{x}" or s.isdigit() else s for s in o.split(" ")[1].split("/") if s))
    end = lambda a, b: 0 < len(a) < len(b) and b[-len(a) :] == a
    for o in ops:
        m, p = split(o)
        if m == "WS":
            want = ("non-http", None)
        else:
            steps = [("documented", lambda dm, dp: dm == m and dp == p), ("suffix-verify", lambda dm, dp: dm == m and (end(p, dp) or end(dp, p))), ("undocumented-method", lambda dm, dp: dp == p)]
            want = next(((name, d) for name, test in steps for _, d in docs if test(*split(d))), ("undocumented-path", None))
        assert got[o] == want, o


def test_correlate(spark):
    t = spark.createDataFrame([("f1", "GET", "/orders/{id}/items"), ("f2", "GET", "/${host}/items"), ("f3", "GET", "/users"), ("f4", "GET", "/${h}/users")], "finding string, method string, path string")
    o = spark.createDataFrame([("GET", "https://x.io/orders/42/items"), ("GET", "https://x.io/users"), ("GET", "https://x.io/admin/none")], "method string, url string")
    assert [tuple(r) for r in correlate.correlate(t, o).collect()] == [("f1", "https://x.io/orders/42/items")]


def test_merge(spark):
    rows = spark.createDataFrame([("h", 1, "fetch", ["b", "a"], None), ("h", 2, "jquery", ["c", "b"], "p")], "h string, o int, kind string, tags array<string>, path string")
    r = findings.merge_findings(rows, ["h"], "o", ["path"], ["tags"], ["kind"]).first()
    assert (r.kind, r.tags, r.path, r.sightings) == (None, ["a", "b", "c"], "p", 2)


def test_spans_and_budget(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in intervals.merge_spans(s, ["k"], "s", "e").collect()) == [(0, 7), (9, 10)]
    assert intervals.within_budget(s, ["k"], ["s"], "e", 12).count() == 2


def test_secret_offsets(spark):
    rows = spark.createDataFrame([(1, "é " + "a" * 32 + " x " + "a" * 32)], "id int, t string")
    got = text.secret_sightings(rows, "id", "t").orderBy("offset_start").collect()
    assert [(r.offset_start, r.offset_end, r.n_th) for r in got] == [(3, 35, 1), (38, 70, 2)]
    held = rows.join(text.secret_sightings(rows, "id", "t"), "id").select(text.secret_holds(F.col("t"), F.col("offset_start"), F.col("offset_end"), F.col("secret")).alias("x"))
    assert all(r.x for r in held.collect())
