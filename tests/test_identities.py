"""Identities, classes and fingerprints on small tables with known results."""

import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

import oracle
from basalt import catalog
from basalt.functions import identity, labels, normalize, urls
from basalt.operators import correlate, fingerprints
from basalt.streaming import events


def many(spark, values, made):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r.y for r in rows.select("k", made(F.col("x")).alias("y")).orderBy("k").collect()]


def plain_hash(kind, value):
    text = json.dumps({"type": kind, "v": 2, "value": unicodedata.normalize("NFC", value)}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["GET /a", 'GET /a?"q', "GET /\u00e9", "GET /e\u0301", "GET /\\x", "GET /\t\x01\x7f", "GET /\U0001f600", ""]


def test_finding_hash_of_any_text(spark):
    rows = spark.createDataFrame([(v,) for v in ODD * 2], "value string")
    got = {r.value: r.finding_hash for r in identity.with_finding_hash(rows, F.lit("endpoint"), "value").collect()}
    assert got == {v: plain_hash("endpoint", v) for v in ODD}
    assert many(spark, ODD, lambda x: identity.finding_hash(F.lit("endpoint"), x)) == [plain_hash("endpoint", v) for v in ODD]


@pytest.fixture
def odd_pages(spark, tmp_path):
    urls_ = ["https://x.io/a?%22q=1", "https://x.io/a?%C3%A9=1", "https://x.io/u/%34%32", "https://x.io/u/%2F", "https://x.io/\u00e9", "https://x.io/a?k=1", "https://x.io/u/42", None]
    spark.createDataFrame([(k, u, "<html></html>") for k, u in enumerate(urls_)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{tmp_path}/p/*.parquet")[0], f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["g14_finding_hash", "g07_endpoint_identity", "c02_sightings", "c03_overlay", "d01_finding_merge"])
def test_odd_urls_equal_sql(spark, odd_pages, name):
    assert oracle.differs(spark, odd_pages, catalog.queries()[name], catalog.oracle_sql()[name]) is None


def test_odd_urls(spark, odd_pages):
    out = {r.page_id: (r.value) for r in catalog.queries()["g07_endpoint_identity"](spark, odd_pages).collect()}
    assert out[0] == 'GET /a?"q' and out[1] == "GET /a?\u00e9" and out[2] == out[6] == "GET /u/{id}" and out[3] == "GET /u/%2F"
    hashes = {r.finding_hash for r in catalog.queries()["g14_finding_hash"](spark, odd_pages).collect()}
    assert hashes == {plain_hash("endpoint", v) for v in out.values()}


def test_decoding_leaves_separators(spark):
    assert many(spark, ["%41%7e", "%2F%25", "%4", "%%41", "a%zz", ""], urls.decode_unreserved) == ["A~", "%2F%25", "%4", "%A", "a%zz", ""]


def test_occurrence_hash_keeps_nulls(spark):
    want = hashlib.sha256(b'{"end":7,"host":null,"kind":"x"}').hexdigest()
    row = spark.range(1).select(identity.occurrence_hash(kind=F.lit("x"), host=F.lit(None).cast("string"), end=F.lit(7)).alias("h")).first()
    assert row.h == want


def test_source_paths(spark):
    given = [None, " ", "webpack://App/./src/../lib/app.9f8e7d6c.js", "../../x.js", "C:\\a\\b.js", "decade.js", "a/deadbee1", "x.aaaaaaaa.js"]
    want = ["{null-source}", "{null-source}", "app/lib/app.{hash}.js", "x.js", "a/b.js", "decade.js", "a/{hash}", "x.aaaaaaaa.js"]
    assert many(spark, given, normalize.source_path) == want


def test_secret_values(spark):
    row = spark.range(1).select(normalize.secret_value(F.lit("\"'k-=y)\n"), F.lit("kingfisher.stripe.2")).alias("v")).first()
    assert row.v == "stripe:" + hashlib.sha256(b"k-=y").hexdigest()
    assert many(spark, ["", "..", "kingfisher", None], normalize.provider) == ["unknown"] * 4


def test_risk_tags(spark):
    given = ["userId", "android", "api_key", "nextPageToken", "APIToken", "sessionStorage", "isBetaAdmin", None, ""]
    want = [["idor"], [], ["auth"], [], ["auth"], [], ["admin", "flag"], [], []]
    assert many(spark, given, labels.risk_tags) == want


def test_failures(spark):
    given = ["HTTP 403", "not in engagement scope: 10.1.1.1", "not in engagement scope: a.io", "exceeds 5 bytes", "at 10.0.0.1: non-public address", "?"]
    got = [(r["category"], r["host"], r["status"]) for r in many(spark, given, labels.failure)]
    assert got == [("access_denied", None, 403), ("out_of_scope", None, None), ("out_of_scope", "a.io", None), ("too_large", None, None), ("blocked_address", None, None), ("unknown", None, None)]


def test_addresses(spark):
    import ipaddress

    given = ["8.8.8.8", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.169.254", "172.15.0.1", "172.16.0.1", "192.0.0.8", "192.168.9.9", "198.18.0.1", "203.0.113.7", "224.0.0.1", "240.0.0.1", "255.255.255.255", "0.1.1.1"]
    rule = lambda a: ipaddress.ip_address(a).is_global and not ipaddress.ip_address(a).is_reserved and not ipaddress.ip_address(a).is_multicast
    assert many(spark, given, labels.public_ipv4) == [rule(a) for a in given]


def test_canonical_paths(spark):
    given = ["/a/{id}/{id}/${slug}/x${y}/$z", "/", "/plain/path"]
    assert many(spark, given, correlate.canonical_path) == ["/a/{id}/{id2}/{slug}/{p1}/{p2}", "/", "/plain/path"]


def test_versions_are_filled_once(spark):
    rows = spark.createDataFrame([("v\\1.\\2", ["\\2", "7"]), ("\\1?yes:no", [""]), ("\\1?a\\1:no", ["x"]), ("", ["x"]), (None, ["x"]), ("\\3", ["x"])], "t string, g array<string>")
    assert [r.v for r in rows.select(fingerprints.resolved_version(F.col("t"), F.col("g")).alias("v")).collect()] == ["v\\2.7", "no", "ax", None, None, None]


def test_detections(spark):
    rules = [("js-a", "js", "jQuery.fn", "\\;confidence:40"), ("js-b", "js", "Vue", "\\;confidence:30"), ("web", "header", "server", "nginx/([0-9.]+)\\;version:\\1\\;confidence:60"), ("web", "js", "__ngx", "\\;confidence:90"), ("ck", "cookie", "sid", "")]
    signals = [("h", "header", "server", "nginx/1.2"), ("h", "header", "via", "nginx/9"), ("h", "scripts", "", "window.jQuery.fn = __ngx; Vue"), ("h", "cookie", "sid", "sid")]
    parsed = fingerprints.parsed_rules(spark.createDataFrame(rules, "tech string, surface string, key string, value string"))
    got = {r.tech: (r.confidence, r.version) for r in fingerprints.detections(spark.createDataFrame(signals, "host string, surface string, key string, value string"), parsed).collect()}
    assert got == {"js-a": (40, None), "web": (100, "1.2"), "ck": (100, None)}


def test_native_fold_equals_the_stream_fold(spark):
    import random

    rng = random.Random(3)
    logs = [[rng.choice([*events.STATES, "other"]) for _ in range(rng.randrange(8))] for _ in range(200)]
    rows = spark.createDataFrame([(k, log) for k, log in enumerate(logs)], "k int, log array<string>")
    got = [r.s for r in rows.select("k", events.folded(F.col("log")).alias("s")).orderBy("k").collect()]
    assert got == [events.fold_state(None, log) for log in logs]
