"""Queries over sources, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import identity, scope, text, urls
from basalt.operators import intervals
from basalt.plans import sql
from basalt.sources.views import endpoints, links, table

SCOPE = ["*.ththth.example.net", "example.com.", "com", "no_label", "10.0.0.1"]
SUFFIXES = ["com", "net", "org"]
DENIED = ["*.example.org", "/de/*", "blog.*/en/*"]


def a03_object_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", identity.object_key(F.lit("t1"), F.pmod("page_id", F.lit(8)).cast("string"), F.lit("asset"), F.col("html")).alias("key"))


def a05_asset_seed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value"))["event_id"].alias("event_id"), F.min_by("value", "event_id").alias("value"))


def a09_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Script URLs of crawler lines (`request.endpoint`, else `endpoint`; broken lines skipped), each with its first line."""
    url = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(urls.part(F.col("url"), urls.SCHEME), F.lit("://"), urls.part(F.col("url"), urls.AUTHORITY), F.lit("/app.js?v=1"))).otherwise(F.col("url"))
    shape = F.pmod("page_id", F.lit(3))
    line = F.when(shape == 0, F.to_json(F.struct(F.struct(url.alias("endpoint")).alias("request")))).when(shape == 1, F.to_json(F.struct(url.alias("endpoint")))).otherwise("{broken")
    found = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", line.alias("line"))
    found = found.select("page_id", F.coalesce(F.get_json_object("line", "$.request.endpoint"), F.get_json_object("line", "$.endpoint")).alias("url"))
    scripts = found.where(urls.part(F.col("url"), urls.SCHEME).isin("http", "https") & F.endswith(urls.part(F.col("url"), urls.PATH), F.lit(".js")))
    return scripts.groupBy("url").agg(F.min("page_id").alias("first"))


def a18_observed_fold(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.concat(urls.part(F.col("url"), urls.SCHEME), F.lit("://"), urls.part(F.col("url"), urls.AUTHORITY), urls.part(F.col("url"), urls.PATH))
    return table(spark, sf, "pages").where("url IS NOT NULL").groupBy(F.lit("GET").alias("method"), bare.alias("observed")).agg(F.count(F.lit(1)).alias("times"))


def a20_shared_url(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.col("source").alias("url"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    unique = docs.where("url IS NOT NULL").groupBy("url").agg((F.min("sha") == F.max("sha")).alias("alone"))
    name = F.when(F.col("url").isNull(), F.concat(F.lit("vm://"), "sha")).when(F.col("alone"), F.col("url")).otherwise(F.concat("url", F.lit("#sha256="), "sha"))
    return docs.join(unique, "url", "left").select("doc_id", name.alias("asset_url"))


def b04_host_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    hosts = endpoints(spark, sf, hashed=False).select("host").distinct()
    return hosts.select("host", scope.in_scope(F.col("host"), SCOPE, SUFFIXES).alias("inside"))


def b14_text_search(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).where(F.contains(F.lower(F.concat_ws(" ", "url", "href")), F.lit("/an"))).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "href")


def b18_glob_denylist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", urls.glob_match(F.col("url"), DENIED).alias("denied"))


def b19_third_party(spark: SparkSession, sf: str) -> DataFrame:
    h = endpoints(spark, sf, hashed=False).where("host IS NOT NULL")
    return h.groupBy(scope.last_labels(F.col("host")).alias("site")).agg(F.count(F.lit(1)).alias("n"), F.max((scope.last_labels(F.col("host")) != "example.com").cast("int")).alias("third_party"))


def e12_truncate(spark: SparkSession, sf: str) -> DataFrame:
    most = 2 * 1024 * 1024
    head = F.substring(F.encode("text", "UTF-8"), F.lit(1), F.lit(most))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.length(head).cast("long").alias("n_bytes"), F.sha2(head, 256).alias("sha"), (F.octet_length("text") > most).alias("truncated"))


def g01_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of whole texts, from one count of characters over all of them."""
    chars = table(spark, sf, "documents").select("doc_id", F.explode_outer(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")).alias("c"))
    counts = chars.groupBy("doc_id", "c").agg(F.count("c").alias("n"))
    n, logs = F.sum("n"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")))
    return counts.groupBy("doc_id").agg(F.round(F.coalesce(F.when(n > 0, F.log2(n) - logs / n), F.lit(0.0)), 6).alias("bits"))


def g05_query_keys(spark: SparkSession, sf: str) -> DataFrame:
    q = urls.query_keys(urls.part(F.col("url"), urls.QUERY))
    return table(spark, sf, "pages").where("url IS NOT NULL").groupBy(q.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def g07_endpoint_identity(spark: SparkSession, sf: str) -> DataFrame:
    return endpoints(spark, sf, hashed=False).select("page_id", "operation", "value", "host")


def g14_finding_hash(spark: SparkSession, sf: str) -> DataFrame:
    return endpoints(spark, sf).groupBy("finding_hash").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))


def g22_dependency_type(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).groupBy(urls.reference_kind(F.col("href")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def g23_byte_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.byte_offset(F.col("text"), F.lit(2), F.lit(3)).cast("long").alias("at"))


def g27_minified(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.minified(F.col("text")).alias("minified"))


def g30_etag(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(k % 5 != 0, k).alias("k"))
    return e.select("event_id", identity.short_tag(F.col("event_type"), F.col("k"), F.lit(False).cast("string")).alias("etag"))


def g32_backoff(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", F.least(F.lit(60.0), F.lit(2.0) * F.pow(F.lit(2.0), F.greatest(k % 8, F.lit(1)) - 1)).alias("ceiling"))


def g36_control_free(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(text.control_free(F.col("text")).cast("binary"), 256).alias("sha"))


def h16_route_gate(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).where(urls.looks_like_route(F.col("href"))).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


def h33_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("href").alias("n_distinct"), F.min("href").alias("first"))


def i03_secret_sightings(spark: SparkSession, sf: str) -> DataFrame:
    found = text.secret_sightings(table(spark, sf, "documents"), "doc_id", "text", text.SECRET_RULES + text.LIKELY_SECRETS)
    return found.select(F.col("id").alias("doc_id"), "rule", "secret", F.col("offset_start").cast("long").alias("offset_start"), F.col("offset_end").cast("long").alias("offset_end"), F.col("n_th").cast("long").alias("n_th"))


def d28_secret_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.secret_count(F.col("text")).cast("long").alias("n"))


def j07_js_budget(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", "url", urls.host(F.col("url")).alias("host"), F.octet_length("html").cast("long").alias("size"))
    return intervals.within_budget(pages, ["host"], ["url", "page_id"], "size", 2_000_000).select("page_id", "host", "running")


def _sightings_sql(rules: tuple) -> str:
    one = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, regexp_extract_all(text, {sql.quoted(p)}) AS m, regexp_split_to_array(text, {sql.quoted(p)}) AS g FROM documents WHERE text IS NOT NULL" for n, p in rules)
    start = "coalesce(list_sum(list_transform(g[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0)"
    return f"WITH r AS ({one}), i AS (SELECT doc_id, rule, m, g, unnest(range(1, len(m) + 1)) AS i FROM r), s AS (SELECT doc_id, rule, split_part(rule, '.', 1) || ':' || sha256(m[i]) AS secret, CAST({start} AS BIGINT) AS offset_start, strlen(m[i]) AS n FROM i) SELECT doc_id, rule, secret, offset_start, CAST(offset_start + n AS BIGINT) AS offset_end, row_number() OVER (PARTITION BY doc_id, rule, secret ORDER BY offset_start) AS n_th FROM s"


LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
E, L = sql.ENDPOINTS, sql.LINKS

QUERIES = {
    "a03_object_keys": (a03_object_keys, "SELECT page_id, 't1/' || CAST(page_id % 8 AS VARCHAR) || '/asset/' || sha256(html) AS key FROM pages"),
    "a05_asset_seed": (a05_asset_seed, "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL"),
    "a09_json_lines": (a09_json_lines, f"WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, {sql.URL}, 1) || '://' || regexp_extract(url, {sql.URL}, 2) || '/app.js?v=1' ELSE url END AS url FROM pages WHERE url IS NOT NULL AND page_id % 3 < 2) SELECT url, min(page_id) AS first FROM u WHERE regexp_extract(url, {sql.URL}, 1) IN ('http', 'https') AND ends_with(regexp_extract(url, {sql.URL}, 3), '.js') GROUP BY url"),
    "a18_observed_fold": (a18_observed_fold, f"SELECT 'GET' AS method, regexp_extract(url, {sql.URL}, 1) || '://' || regexp_extract(url, {sql.URL}, 2) || regexp_extract(url, {sql.URL}, 3) AS observed, count(*) AS times FROM pages WHERE url IS NOT NULL GROUP BY ALL"),
    "a20_shared_url": (a20_shared_url, "WITH d AS (SELECT doc_id, source AS url, sha256(text) AS sha FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN url IS NULL THEN 'vm://' || sha WHEN min(sha) OVER p = max(sha) OVER p THEN url ELSE url || '#sha256=' || sha END AS asset_url FROM d WINDOW p AS (PARTITION BY url)"),
    "b04_host_in_scope": (b04_host_in_scope, f"WITH {E} SELECT host, coalesce(host = 'ththth.example.net' OR ends_with(host, '.ththth.example.net') OR host = 'example.com' OR ends_with(host, '.example.com'), false) AS inside FROM (SELECT DISTINCT host FROM ep)"),
    "b14_text_search": (b14_text_search, f"WITH {L} SELECT page_id, ordinal, href FROM links WHERE contains(lower(concat_ws(' ', url, href)), '/an')"),
    "b18_glob_denylist": (b18_glob_denylist, f"SELECT page_id, (regexp_matches({sql.host('url')}, '^.*\\.example\\.org$') OR regexp_matches(lower(regexp_extract(url, {sql.URL}, 3)), '^/de/.*$') OR regexp_matches({sql.host('url')} || lower(regexp_extract(url, {sql.URL}, 3)), '^blog\\..*/en/.*$')) AS denied FROM pages WHERE url IS NOT NULL"),
    "b19_third_party": (b19_third_party, f"WITH {E}, s AS (SELECT CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS site FROM ep WHERE host IS NOT NULL) SELECT site, count(*) AS n, CAST(site <> 'example.com' AS INTEGER) AS third_party FROM s GROUP BY site"),
    "e12_truncate": (e12_truncate, "SELECT doc_id, CAST(least(strlen(text), 2097152) AS BIGINT) AS n_bytes, sha256(encode(text)[1:2097152]) AS sha, strlen(text) > 2097152 AS truncated FROM documents WHERE text IS NOT NULL"),
    "g01_entropy": (g01_entropy, "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE coalesce(text, '') <> ''), k AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL), b AS (SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM k GROUP BY doc_id) SELECT doc_id, coalesce(bits, 0.0) AS bits FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN b USING (doc_id)"),
    "g05_query_keys": (g05_query_keys, f"WITH {E} SELECT keys, count(*) AS n FROM ep GROUP BY keys"),
    "g07_endpoint_identity": (g07_endpoint_identity, f"WITH {E} SELECT page_id, operation, value, host FROM ep"),
    "g14_finding_hash": (g14_finding_hash, f"WITH {E} SELECT finding_hash, min(value) AS value, count(*) AS n FROM ep GROUP BY finding_hash"),
    "g22_dependency_type": (g22_dependency_type, f"WITH {L} SELECT CASE WHEN regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN 'absolute' WHEN starts_with(href, '/') THEN 'root' WHEN starts_with(href, '.') THEN 'relative' ELSE 'package' END AS kind, count(*) AS n FROM links GROUP BY ALL"),
    "g23_byte_offset": (g23_byte_offset, "WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations) SELECT conv_id, turn, CAST(CASE WHEN len(x) >= 2 AND length(x[2]) >= 3 THEN strlen(x[1]) + 1 + strlen(left(x[2], 3)) END AS BIGINT) AS at FROM l"),
    "g27_minified": (g27_minified, "SELECT doc_id, len(list_filter(string_split(text, chr(10))[1:200], lambda l: length(l) > 500)) > 0 AS minified FROM documents WHERE text IS NOT NULL"),
    "g30_etag": (g30_etag, "WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, left(sha256(event_type || ':' || CASE WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) ELSE 'None' END || ':false'), 16) AS etag FROM e"),
    "g32_backoff": (g32_backoff, "SELECT event_id, least(60.0::DOUBLE, 2.0 * pow(2.0, greatest(CAST(json_extract_string(props, '$.k') AS INTEGER) % 8, 1) - 1)) AS ceiling FROM events"),
    "g36_control_free": (g36_control_free, r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')) AS sha FROM documents WHERE text IS NOT NULL"),
    "h16_route_gate": (h16_route_gate, f"WITH {L} SELECT href, count(*) AS n FROM links WHERE regexp_matches(href, '^(https?://[^/]|/[^/])') AND NOT regexp_matches(href, '[\\x00-\\x20<>\"|^`*;,]') AND NOT regexp_matches(lower(href), '\\.(css|png|jpe?g|gif|svg|ico|woff2?|ttf|map)([?#].*)?$') GROUP BY href"),
    "h33_dependencies": (h33_dependencies, f"WITH {L} SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_distinct, min(href) AS first FROM links GROUP BY page_id"),
    "i03_secret_sightings": (i03_secret_sightings, _sightings_sql(text.SECRET_RULES + text.LIKELY_SECRETS)),
    "d28_secret_count": (d28_secret_count, "SELECT doc_id, CAST(least(len(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(coalesce(text, ''), {sql.quoted(p)})" for _, p in text.LIKELY_SECRETS) + "))), 999) AS BIGINT) AS n FROM documents"),
    "j07_js_budget": (j07_js_budget, f"WITH p AS (SELECT page_id, url, {sql.host('url')} AS host, strlen(html) AS size FROM pages WHERE url IS NOT NULL), r AS (SELECT page_id, host, CAST(sum(size) OVER (PARTITION BY host ORDER BY url, page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM p) SELECT * FROM r WHERE running <= 2000000"),
}
