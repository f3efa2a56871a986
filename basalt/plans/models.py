"""Queries over merges, read models, rules and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import scope, urls
from basalt.operators import correlate as match
from basalt.operators import findings as merge
from basalt.operators import intervals
from basalt.plans import sql
from basalt.plans.scans import SCOPE, SUFFIXES
from basalt.sources.views import endpoints, links, table
from basalt.streaming import events

DOCUMENTED = ("GET /fr/{id}", "GET /v1/en/{code}", "POST /de/{id}", "GET /es", "GET /es/{a}/{b}")
RULES = ((0, "https://api.example.com", "/fr"), (1, "https://edge.example.com", "/"), (2, "https://second.example.com", "/fr"))


def documented(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DOCUMENTED)), "ord int, operation string")


def c02_sightings(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf).select("run_id", F.pmod("run_id", F.lit(2)).alias("engagement"), "finding_hash", F.when(F.col("run_id") < 4, "capture").otherwise("platform").alias("origin"))
    out = merge.sightings(ep, "run_id", "engagement", "finding_hash", "origin", ["capture", "platform"])
    return out.select("run_id", "finding_hash", F.col("from_capture").cast("long").alias("from_capture"), F.col("from_platform").cast("long").alias("from_platform"))


def c03_overlay(spark: SparkSession, sf: str) -> DataFrame:
    found = endpoints(spark, sf).select("finding_hash", "operation").distinct()
    verdicts = found.where(F.startswith("operation", F.lit("GET /fr"))).select("finding_hash", F.lit("confirmed").alias("triage"))
    seen = endpoints(spark, sf).groupBy("finding_hash").agg(F.count_distinct("run_id").alias("runs")).where("runs > 1")
    return merge.overlay(found, [(verdicts, ["finding_hash"], {"triage": None}), (seen, ["finding_hash"], {"runs": 0})])


def c06_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    orders, items = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    back = orders.join(items, orders.o_orderkey == items.l_orderkey, "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("returned"))
    rest = orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("clean"))
    return back.join(rest, "o_custkey", "full").select("o_custkey", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("clean", F.lit(0)).alias("clean"))


def c10_correlate(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    templates = ep.select(F.col("finding_hash").alias("finding"), F.lit("GET").alias("method"), F.regexp_replace("operation", "^GET ", "").alias("path")).distinct()
    observed = ep.select(F.lit("GET").alias("method"), "url")
    return match.correlate(templates, observed)


def c11_classify(spark: SparkSession, sf: str) -> DataFrame:
    return match.classify(endpoints(spark, sf, hashed=False).select("operation"), documented(spark))


def c12_base_url_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "ord int, base_url string, path_prefix string")
    return match.base_url_overlay(endpoints(spark, sf, hashed=False).select("operation"), rules)


def c18_context_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    pairs = intervals.within_after(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", 3600)
    return pairs.groupBy(F.col("a.event_id").alias("context")).agg(F.min("b.event_id").alias("completion"))


def d01_finding_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = endpoints(spark, sf).select("finding_hash", "page_id", "host", "value", F.split(F.split_part("value", F.lit("?"), F.lit(2)), "&").alias("tags"), F.when(F.col("run_id") < 6, "fetch").otherwise("xhr").alias("kind"))
    out = merge.merge_findings(rows, ["finding_hash"], "page_id", ["host", "value"], ["tags"], ["kind"])
    return out.withColumn("tags", F.array_join("tags", ","))


def d02_occurrence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = links(spark, sf).select("page_id", "run_id", "href", F.col("ordinal").cast("long").alias("ordinal"), F.struct("page_id", "ordinal").alias("place"))
    return merge.dedupe_occurrences(rows, ["run_id", "href"], "place", ["page_id", "ordinal"])


def d05_coverage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events").select("user_id", "event_id", k.alias("attributed"), (k % 7).alias("unattributed"), (F.col("event_type") == "error").alias("failed"), F.col("event_type").alias("source_map"))
    out = merge.coverage(e, "user_id", "event_id", ["attributed", "unattributed"], ["failed"], ["source_map"], F.pmod(F.col("user_id"), F.lit(2)) == 0)
    return out.withColumn("percent", merge.percent(F.col("attributed"), F.col("attributed") + F.col("unattributed")))


def d08_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def d09_percent(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("total"))
    return o.select("o_custkey", "done", "total", merge.percent(F.col("done"), F.col("total")).alias("percent"))


def d11_host_rollup(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf).select("host", "finding_hash", F.when(F.contains("value", F.lit("?")), "query").otherwise("plain").alias("lane"))
    return merge.host_rollup(ep, "host", "finding_hash", "lane", ["query", "plain"])


def d12_host_inventory(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf).where("host IS NOT NULL").select("host", F.col("finding_hash").alias("endpoint"), F.lit(None).cast("string").alias("route"), F.lit(0).alias("asset"))
    routes = links(spark, sf).where(urls.looks_like_route(F.col("href"))).select(urls.host(F.col("url")).alias("host"), F.lit(None).cast("string").alias("endpoint"), F.col("href").alias("route"), F.lit(0).alias("asset"))
    assets = table(spark, sf, "pages").where(F.col("url").rlike("^https?://")).select(urls.host(F.col("url")).alias("host"), F.lit(None).cast("string").alias("endpoint"), F.lit(None).cast("string").alias("route"), F.lit(1).alias("asset"))
    rows = ep.unionByName(routes).unionByName(assets).where("host <> ''")
    out = rows.groupBy("host").agg(F.count_distinct("endpoint").alias("endpoints"), F.count_distinct("route").alias("routes"), F.sum("asset").alias("assets"))
    return out.withColumn("in_scope", scope.in_scope(F.col("host"), SCOPE, SUFFIXES))


def d14_spec_summary(spark: SparkSession, sf: str) -> DataFrame:
    return match.summary(c11_classify(spark, sf))


def d16_request_assembly(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    keys = F.when(F.contains("value", F.lit("?")), F.split(F.split_part("value", F.lit("?"), F.lit(2)), "&")).otherwise(F.array().cast("array<string>"))
    out = ep.groupBy("operation").agg(
        F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(keys)))), ",").alias("params"),
        F.min_by("url", F.struct("finding_hash", "page_id")).alias("example_url"),
        F.count_distinct("finding_hash").alias("findings"),
    )
    return out


def d20_facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return merge.facets(endpoints(spark, sf, hashed=False), ["host", "run_id"])


def d22_tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return merge.prefix_rollup(table(spark, sf, "pages").where("url IS NOT NULL").select(urls.part(F.col("url"), urls.PATH).alias("path"), F.length("html").cast("long").alias("n")), "path", "n")


def d24_path_tag(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.coalesce(F.try_element_at(urls.segments(F.regexp_replace("operation", "^[A-Z]+ ", "")), F.lit(1)), F.lit("(root)"))
    return endpoints(spark, sf, hashed=False).groupBy(tag.alias("tag")).agg(F.count_distinct("operation").alias("operations"))


def d26_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "done").otherwise("partial").alias("state"))


def e03_latest(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])


def e07_top_priority(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy(rank, F.desc("value"), "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("place")).where("place <= 6")


def e08_capped(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf, hashed=False).where("host IS NOT NULL").select("host", "page_id", "url")
    return intervals.first_n(ep, ["host"], ["url", "page_id"], 3).select("host", "page_id", "place", "capped")


def f02_merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf, "events").select("user_id", start.alias("start"), (start + (F.col("value") * 60e6).cast("long")).alias("end"))
    return intervals.merge_spans(e, ["user_id"], "start", "end", slot=86_400_000_000)


def f06_run_diff(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    return merge.run_diff(ep.where("run_id < 4"), ep.where("run_id >= 4"), "finding_hash", complete=True)


def k19_servers(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf, hashed=False).where("host IS NOT NULL")
    return ep.groupBy("host").agg(F.concat(F.max(urls.part(F.col("url"), urls.SCHEME)), F.lit("://"), F.first("host")).alias("origin"))


def l01_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf).select("run_id", "finding_hash", "page_id")
    there, new = ep.where("page_id % 2 = 0"), ep.where("page_id % 2 = 1")
    first = new.groupBy("run_id", "finding_hash").agg(F.min("page_id").alias("page_id"))
    return first.join(there, ["run_id", "finding_hash"], "left_anti")


def l03_coalesce_upsert(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.when(k % 3 == 0, k).alias("note"))
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max(F.when(F.col("note").isNotNull(), F.struct("event_id", "note")))["note"].alias("note"))


def m06_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(-1)
    e = table(spark, sf, "events").select("user_id", F.window("ts", "1 day").start.alias("day"), F.struct(rank.alias("r"), "event_type").alias("s"))
    return e.where("s.r >= 0").groupBy("user_id", "day").agg(F.max("s")["event_type"].alias("state"))


def m08_tumbling_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").start.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return e.where("n > 14")


def m10_session_throttle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'")
    out = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return out.where("n >= 3").select("user_id", "first", "n")


def m13_progress(spark: SparkSession, sf: str) -> DataFrame:
    """done of total (60, 80 or 100, as the last event says) for each stage."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.least(k, F.lit(60)).alias("done"), (F.lit(60) + F.pmod("event_id", F.lit(3)) * 20).cast("long").alias("total"))
    top = e.groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "done", "total")).alias("x"))
    return top.select("user_id", "event_type", "x.done", "x.total", F.coalesce(merge.percent(F.col("x.done"), F.col("x.total")), F.lit(0)).alias("percent"))


def m06_guarded_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each user after all events in order, under the rules of the stream's fold."""
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "paused").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", state.alias("s")))).alias("log"))
    return e.select("user_id", events.folded(F.transform("log", lambda x: x["s"])).alias("state"))


def m15_content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


E, L = sql.ENDPOINTS, sql.LINKS
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_WILD = "list_transform({}, lambda s: CASE WHEN regexp_matches(s, '^(\\{{[^{{}}]*\\}}|\\$\\{{[^{{}}]*\\}}|:[A-Za-z_][A-Za-z0-9_]*)$') OR regexp_matches(s, '^[0-9]+$') THEN '*' ELSE s END)"
_SEGS = _WILD.format(sql.segments("regexp_replace(operation, '^[^ ]* ', '')"))
CLASSIFY = f"""WITH {E},
o AS (SELECT DISTINCT operation, split_part(operation, ' ', 1) AS method, {_SEGS} AS segs FROM ep),
d AS (SELECT ord, operation AS doc, split_part(operation, ' ', 1) AS method, {_SEGS} AS segs FROM (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(DOCUMENTED))}) t(ord, operation)),
m AS (SELECT o.operation, d.ord, d.doc, CASE WHEN o.method = d.method AND o.segs = d.segs THEN 1
  WHEN o.method = d.method AND len(o.segs) > 0 AND len(o.segs) < len(d.segs) AND d.segs[len(d.segs) - len(o.segs) + 1:] = o.segs THEN 2
  WHEN o.method = d.method AND len(d.segs) > 0 AND len(d.segs) < len(o.segs) AND o.segs[len(o.segs) - len(d.segs) + 1:] = d.segs THEN 2
  WHEN o.method <> d.method AND o.segs = d.segs THEN 3 END AS step FROM o JOIN d ON true),
b AS (SELECT operation, min(step) AS step FROM m WHERE step IS NOT NULL GROUP BY operation),
p AS (SELECT m.operation, b.step, arg_min(m.doc, m.ord) AS doc FROM m JOIN b ON m.operation = b.operation AND m.step = b.step GROUP BY ALL),
verdict AS (SELECT o.operation, CASE p.step WHEN 1 THEN 'documented' WHEN 2 THEN 'unresolved' ELSE 'shadow' END AS status,
  CASE p.step WHEN 1 THEN 'documented' WHEN 2 THEN 'suffix-verify' WHEN 3 THEN 'undocumented-method' ELSE 'undocumented-path' END AS reason, p.doc AS matched FROM o LEFT JOIN p ON o.operation = p.operation)"""

QUERIES = {
    "c02_sightings": (c02_sightings, f"WITH {E}, m AS (SELECT DISTINCT run_id, run_id % 2 AS g, finding_hash, CASE WHEN run_id < 4 THEN 'capture' ELSE 'platform' END AS origin FROM ep) SELECT a.run_id, a.finding_hash, count(*) FILTER (b.origin = 'capture' AND b.run_id <> a.run_id) AS from_capture, count(*) FILTER (b.origin = 'platform' AND b.run_id <> a.run_id) AS from_platform FROM m a JOIN m b ON a.g = b.g AND a.finding_hash = b.finding_hash GROUP BY a.run_id, a.finding_hash"),
    "c03_overlay": (c03_overlay, f"WITH {E}, f AS (SELECT DISTINCT finding_hash, operation FROM ep), s AS (SELECT finding_hash, count(DISTINCT run_id) AS runs FROM ep GROUP BY finding_hash HAVING count(DISTINCT run_id) > 1) SELECT f.finding_hash, f.operation, CASE WHEN starts_with(operation, 'GET /fr') THEN 'confirmed' END AS triage, coalesce(s.runs, 0) AS runs FROM f LEFT JOIN s ON f.finding_hash = s.finding_hash"),
    "c06_semi_anti": (c06_semi_anti, "SELECT o_custkey, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS returned, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS clean FROM orders GROUP BY o_custkey"),
    "c10_correlate": (c10_correlate, None),
    "c11_classify": (c11_classify, CLASSIFY + " SELECT * FROM verdict"),
    "c12_base_url_overlay": (c12_base_url_overlay, f"WITH {E}, o AS (SELECT DISTINCT operation, split_part(operation, ' ', 2) AS p FROM ep) SELECT operation, CASE WHEN p = '/fr' OR starts_with(p, '/fr/') THEN 'https://api.example.com' ELSE 'https://edge.example.com' END AS base_url FROM o"),
    "c18_context_join": (c18_context_join, "SELECT a.event_id AS context, min(b.event_id) AS completion FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 60 MINUTES GROUP BY a.event_id"),
    "d01_finding_merge": (d01_finding_merge, f"WITH {E}, r AS (SELECT *, CASE WHEN run_id < 6 THEN 'fetch' ELSE 'xhr' END AS kind FROM ep) SELECT finding_hash, arg_min(host, page_id) FILTER (host IS NOT NULL) AS host, min(value) AS value, array_to_string(list_sort(list_distinct(string_split(split_part(min(value), '?', 2), '&'))), ',') AS tags, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS kind, count(*) AS sightings FROM r GROUP BY finding_hash"),
    "d02_occurrence_dedupe": (d02_occurrence_dedupe, f"WITH {L} SELECT run_id, href, arg_min(page_id, (page_id, ordinal)) AS page_id, arg_min(ordinal, (page_id, ordinal)) AS ordinal, count(*) AS copies FROM links GROUP BY run_id, href"),
    "d05_coverage": (d05_coverage, f"WITH e AS (SELECT user_id, event_id, {K} AS a, {K} % 7 AS u, event_type FROM events), c AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN CAST(sum(a) AS BIGINT) ELSE arg_max(a, event_id) END AS attributed, CASE WHEN user_id % 2 = 0 THEN CAST(sum(u) AS BIGINT) ELSE arg_max(u, event_id) END AS unattributed, bool_or(event_type = 'error') AS failed, arg_max(event_type, event_id) AS source_map FROM e GROUP BY user_id) SELECT *, CASE WHEN attributed + unattributed > 0 THEN CAST(round_even(100.0 * attributed / (attributed + unattributed), 0) AS BIGINT) END AS percent FROM c"),
    "d08_type_counts": (d08_type_counts, "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "d09_percent": (d09_percent, "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total, CAST(round_even(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 0) AS BIGINT) AS percent FROM orders GROUP BY o_custkey"),
    "d11_host_rollup": (d11_host_rollup, f"WITH {E} SELECT host, count(DISTINCT finding_hash) FILTER (contains(value, '?')) AS n_query, count(DISTINCT finding_hash) FILTER (NOT contains(value, '?')) AS n_plain FROM ep WHERE host IS NOT NULL GROUP BY host"),
    "d12_host_inventory": (d12_host_inventory, f"WITH {E}, {L}, r AS (SELECT host, finding_hash AS endpoint, NULL AS route, 0 AS asset FROM ep WHERE host IS NOT NULL UNION ALL SELECT {sql.host('url')}, NULL, href, 0 FROM links WHERE regexp_matches(href, '^(https?://[^/]|/[^/])') AND NOT regexp_matches(href, '[\\x00-\\x20<>\"|^`*;,]') AND NOT regexp_matches(lower(href), '\\.(css|png|jpe?g|gif|svg|ico|woff2?|ttf|map)([?#].*)?$') UNION ALL SELECT {sql.host('url')}, NULL, NULL, 1 FROM pages WHERE regexp_matches(url, '^https?://')) SELECT host, count(DISTINCT endpoint) AS endpoints, count(DISTINCT route) AS routes, CAST(sum(asset) AS BIGINT) AS assets, coalesce(host = 'ththth.example.net' OR ends_with(host, '.ththth.example.net') OR host = 'example.com' OR ends_with(host, '.example.com'), false) AS in_scope FROM r WHERE host <> '' GROUP BY host"),
    "d14_spec_summary": (d14_spec_summary, CLASSIFY + " SELECT count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'shadow') AS shadow, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (reason = 'suffix-verify') AS suffix_verify, coalesce(count(*) FILTER (reason = 'suffix-verify') / nullif(count(*) FILTER (status = 'shadow' OR reason = 'suffix-verify'), 0), 0.0) AS ratio FROM verdict"),
    "d16_request_assembly": (d16_request_assembly, f"WITH {E} SELECT operation, array_to_string(list_sort(list_distinct(list(host) FILTER (host IS NOT NULL))), ',') AS hosts, coalesce(array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN keys <> '' THEN string_split(keys, '&') ELSE [] END)))), ','), '') AS params, arg_min(url, (finding_hash, page_id)) AS example_url, count(DISTINCT finding_hash) AS findings FROM ep GROUP BY operation"),
    "d20_facet_counts": (d20_facet_counts, f"WITH {E} SELECT 'host' AS facet, host AS value, count(*) AS n FROM ep WHERE host IS NOT NULL GROUP BY host UNION ALL SELECT 'run_id', CAST(run_id AS VARCHAR), count(*) FROM ep GROUP BY run_id"),
    "d22_tree_rollup": (d22_tree_rollup, f"WITH {E}, s AS (SELECT {sql.segments('ep.path')} AS segs, length(html) AS n FROM ep JOIN pages USING (page_id)), x AS (SELECT segs, n, unnest(range(1, len(segs) + 1)) AS i FROM s) SELECT array_to_string(segs[1:i], '/') AS prefix, CAST(sum(n) AS BIGINT) AS total FROM x GROUP BY 1"),
    "d24_path_tag": (d24_path_tag, f"WITH {E} SELECT coalesce({sql.segments('split_part(operation, chr(32), 2)')}[1], '(root)') AS tag, count(DISTINCT operation) AS operations FROM ep GROUP BY 1"),
    "d26_completeness": (d26_completeness, "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'done' ELSE 'partial' END AS state FROM lineitem GROUP BY l_orderkey"),
    "e03_latest": (e03_latest, "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "e07_top_priority": (e07_top_priority, "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, value DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 6"),
    "e08_capped": (e08_capped, f"WITH {E} SELECT host, page_id, CAST(row_number() OVER (PARTITION BY host ORDER BY url, page_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY host) > 3 AS capped FROM ep WHERE host IS NOT NULL QUALIFY place <= 3"),
    "f02_merge_spans": (f02_merge_spans, 'WITH s AS (SELECT user_id, epoch_us(ts) AS "start", epoch_us(ts) + CAST(trunc(value * 60e6) AS BIGINT) AS "end" FROM events), m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY user_id, island'),
    "f06_run_diff": (f06_run_diff, f"WITH {E}, b AS (SELECT DISTINCT finding_hash FROM ep WHERE run_id < 4), a AS (SELECT DISTINCT finding_hash FROM ep WHERE run_id >= 4) SELECT coalesce(a.finding_hash, b.finding_hash) AS finding_hash, CASE WHEN b.finding_hash IS NULL THEN 'added' WHEN a.finding_hash IS NULL THEN 'removed' ELSE 'kept' END AS change FROM b FULL JOIN a ON a.finding_hash = b.finding_hash"),
    "k19_servers": (k19_servers, f"WITH {E} SELECT host, max(regexp_extract(url, {sql.URL}, 1)) || '://' || host AS origin FROM ep WHERE host IS NOT NULL GROUP BY host"),
    "l01_insert_or_ignore": (l01_insert_or_ignore, f"WITH {E} SELECT run_id, finding_hash, min(page_id) AS page_id FROM ep WHERE page_id % 2 = 1 AND (run_id, finding_hash) NOT IN (SELECT (run_id, finding_hash) FROM ep WHERE page_id % 2 = 0) GROUP BY ALL"),
    "l03_coalesce_upsert": (l03_coalesce_upsert, f"SELECT user_id, arg_max(event_type, event_id) AS status, arg_max({K}, event_id) FILTER ({K} % 3 = 0) AS note FROM events GROUP BY user_id"),
    "m06_state_fold": (m06_state_fold, "WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END AS r FROM events) SELECT user_id, CAST(day AS TIMESTAMP) AS day, arg_max(event_type, r) AS state FROM e WHERE r >= 0 GROUP BY user_id, day"),
    "m08_tumbling_budget": (m08_tumbling_budget, "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS slot, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 14"),
    "m10_session_throttle": (m10_session_throttle, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k HAVING count(*) >= 3"),
    "m06_guarded_fold": (m06_guarded_fold, "WITH e AS (SELECT user_id, list(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE 4 END ORDER BY event_id) AS log FROM events GROUP BY user_id) SELECT user_id, ['queued', 'running', 'paused', 'failed', 'done'][list_reduce(log, lambda a, x: CASE WHEN a >= 4 THEN a WHEN x >= 3 OR a = 3 OR x > a THEN x ELSE a END)] AS state FROM e"),
    "m13_progress": (m13_progress, f"WITH e AS (SELECT user_id, event_type, event_id, least({K}, 60) AS done, 60 + event_id % 3 * 20 AS total FROM events) SELECT user_id, event_type, done, total, CAST(round_even(100.0 * done / total, 0) AS BIGINT) AS percent FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"),
    "m15_content_dedupe": (m15_content_dedupe, "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"),
}
