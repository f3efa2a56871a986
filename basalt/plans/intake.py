"""Queries over what comes in: files, crawler and engine lines, source maps, captured requests and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import intake, normalize, scope, urls
from basalt.operators import findings as merge
from basalt.plans import sql
from basalt.plans.labels import dealt, pick
from basalt.sources.views import endpoints, links, table

MAPS = ['{"a":[1,2],"version":3}', "[1]", "{bad", "", '{"mappings":"AAAA","version":3}', "3"]
LINES = ['{"findings":[{"rule":{"id":"r.a"},"finding":{"snippet":"s1"}},{"rule":{"id":"r.b"},"finding":{"snippet":"s2"}}]}', '{"findings":3}', "log line", '{"findings":[{"rule":{},"finding":{"snippet":"s"}},{"rule":{"id":"r.c"},"finding":{}}]}', '{"other":[]}', ""]
DATA_URLS = ["data:text/plain;base64,aGVsbG8=", "data:text/plain,a%20b%21", "data:,x", "https://x.example", "data:nothing"]
SCRIPTS = ["a();\n//# sourceMappingURL=old.map\n//# sourceMappingURL=data:application/json;base64,eyJ2IjozfQ==", "b();\n//# sourceMappingURL=b.js.map", "c();", "d();\n//# sourceMappingURL=data:application/json,%7B%22v%22%3A3%7D", "e();\n/*# sourceMappingURL=e.map */", "f();\n//# sourceMappingURL=data:application/json;base64,bm8="]
IMPORTS = ["./a", "../b/c", "axios", "../../../x.js", "./", "@scope/pkg"]


def a07_valid_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").where("url <> '' AND html IS NOT NULL").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"))
    return rows.where("n_bytes <= 1500")


def a08_source_map_valid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", intake.object_text(pick(MAPS, F.col("event_id")), 30).alias("map"))


def a10_engine_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = intake.engine_findings(F.when(F.pmod("event_id", F.lit(2)) < 2, pick(LINES, F.col("event_id"))))
    return table(spark, sf, "events").select("event_id", F.explode(found).alias("x")).select("event_id", "x.rule", "x.snippet")


def a11_manifest_status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    manifest = e.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 4)).alias("asset"))
    status = e.where("event_type = 'purchase'").groupBy("user_id", (F.col("k") % 4).alias("asset")).agg(F.max(F.struct("event_id", "k"))["k"].alias("k")).select("user_id", "asset", F.when(F.col("k") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return merge.overlay(manifest, [(status, ["user_id", "asset"], {"status": "pending"})])


def a17_script_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    capped = F.left(F.coalesce("html", F.lit("")), F.lit(1200))
    return table(spark, sf, "pages").groupBy(F.pmod("page_id", F.lit(8)).cast("long").alias("run_id"), F.sha2(capped.cast("binary"), 256).alias("sha")).agg(F.min("page_id").alias("page_id"))


def a19_signal_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.pmod("user_id", F.lit(6)).cast("long").alias("host"), "event_id", "event_type", "value")
    return e.groupBy("host").agg(F.max_by(F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("event_type") != "error", F.col("event_id"))).alias("server"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 5, F.concat(F.lit("c_"), "event_type")))), ",").alias("cookies"))


def a27_inline_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", intake.inline_map(pick(SCRIPTS, F.col("event_id"))).alias("map"))


def a28_external_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", intake.external_map(pick(SCRIPTS, F.col("event_id"))).alias("url"))


def a31_data_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", intake.data_url_text(pick(DATA_URLS, F.col("event_id"))).alias("content"))


def a32_request_metadata(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.pmod("event_id", F.lit(3)) == 0, F.create_map(F.lit("Content-Type"), F.concat(F.lit("text/"), "event_type"))).when(F.pmod("event_id", F.lit(3)) == 1, F.create_map(F.lit("CONTENT-ENCODING"), F.lit("gzip")))
    lowered = F.transform_keys(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    rows = table(spark, sf, "events").select("event_id", lowered.alias("h"))
    return rows.select("event_id", F.coalesce(F.try_element_at("h", F.lit("content-type")), F.lit("application/octet-stream")).alias("content_type"), F.coalesce(F.try_element_at("h", F.lit("content-encoding")), F.lit("identity")).alias("encoding"))


def a33_frontier(spark: SparkSession, sf: str) -> DataFrame:
    refs = links(spark, sf).where("url IS NOT NULL").select(normalize.resolve_reference(F.col("href"), F.col("url")).alias("target")).where("target IS NOT NULL").distinct()
    captured = table(spark, sf, "pages").select(F.col("url").alias("target")).where("target IS NOT NULL")
    return refs.where(~urls.glob_match(F.col("target"), ["*.example.net"])).join(captured, "target", "left_anti")


def a34_loaded_scripts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").where("html IS NOT NULL")
    tags = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<script[^>]* src=\"([^\"]+)\""), F.lit(1))).alias("script"))
    timed = p.where(F.col("url").isNotNull()).select("page_id", F.concat("url", F.lit("#timing.js")).alias("script"))
    return tags.unionByName(timed).distinct()


def b01_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return endpoints(spark, sf, hashed=False).withColumn("tenant", F.pmod("page_id", F.lit(2))).where("tenant = 1").select("page_id", "operation")


def b09_capture_scope(spark: SparkSession, sf: str) -> DataFrame:
    host = F.when(F.pmod("page_id", F.lit(3)) > 0, urls.host(F.col("url")))
    rows = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", F.coalesce(host, F.lit("target.example")).alias("host"))
    return rows.where((F.col("host") == "target.example") | scope.in_scope(F.col("host"), ["example.com"], [])).select("page_id", "host")


def b16_b17_filters(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.lit(None).cast("int")
    ep = endpoints(spark, sf, hashed=False).where(F.contains(F.lower("operation"), F.lit("/fr")))
    return ep.where(wanted.isNull() | (F.pmod("run_id", F.lit(2)) == wanted)).select("operation").distinct()


def b21_capture_gate(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.when(F.pmod("page_id", F.lit(4)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" Example.com "), F.lit("")))
    rows = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", intake.gate(urls.host(F.col("url")), entries, F.pmod("page_id", F.lit(8)) == 0, F.pmod("page_id", F.lit(3)) > 0).alias("inside"))
    return rows


def b24_config(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("event_id"))
    denied = F.when(F.pmod("event_id", F.lit(4)) == 0, F.array(F.col("event_type")))
    mode = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("all"))
    changed = F.array_sort(F.array_compact(F.array(F.when(limit.isNotNull(), "limit"), F.when(denied.isNotNull(), "denied"), F.when(mode.isNotNull(), "mode"))))
    return table(spark, sf, "events").select("event_id", F.coalesce(limit, F.lit(10)).cast("long").alias("limit"), F.array_join(F.coalesce(denied, F.array(F.lit("a"), F.lit("b"))), ",").alias("denied"), F.coalesce(mode, F.lit("some")).alias("mode"), F.array_join(changed, ",").alias("changed"))


def h25_specifier(spark: SparkSession, sf: str) -> DataFrame:
    importer = F.concat(F.lit("src/"), "event_type", F.lit("/deep/mod.js"))
    return table(spark, sf, "events").select("event_id", intake.resolve_specifier(importer, pick(IMPORTS, F.col("event_id"))).alias("module"))


def h26_module_key(spark: SparkSession, sf: str) -> DataFrame:
    path = urls.part(F.col("url"), urls.PATH)
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", F.coalesce(F.nullif(path, F.lit("")), "url").alias("key"))


def h34_map_comment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.nullif(F.regexp_extract(pick(SCRIPTS, F.col("event_id")), intake.MAP_COMMENT, 1), F.lit("")).alias("map"))


def h35_units(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    recovered = F.when(F.pmod("event_id", F.lit(3)) == 0, F.array(F.lit("src/a.js"), F.concat(F.lit("src/"), "event_type"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.pmod("event_id", F.lit(3)) == 0, "recovered").when(F.pmod("event_id", F.lit(3)) == 1, "none").otherwise("failed")
    units = F.when(F.size(recovered) > 0, recovered).otherwise(F.array(F.lit("input.js")))
    return e.select("event_id", status.alias("status"), F.explode(units).alias("unit"))


def k04_correlation_stage(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    bearing = ep.where("host IS NOT NULL AND run_id < 6").select("finding_hash")
    return ep.where("run_id >= 6").join(bearing, "finding_hash", "left_anti").select("finding_hash", F.lit("capture").alias("engine")).distinct()


def k13_request_overlay(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf, hashed=False)
    path = F.regexp_replace("operation", "^[A-Z]+ ", "")
    ruled = F.startswith(path, F.lit("/fr/"))
    moved = ep.select(F.when(ruled, F.concat(F.lit("GET /api"), path)).otherwise(F.col("operation")).alias("operation"), F.when(ruled, F.lit("api.example.com")).otherwise(F.col("host")).alias("host"), F.when(ruled, F.concat(F.lit("https://api.example.com"), path)).otherwise(F.col("url")).alias("example"))
    return moved.groupBy("operation").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"), F.min("example").alias("example"))


def k16_operation_object(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf, hashed=False)
    keys = F.explode_outer(F.filter(F.split(F.split_part("value", F.lit("?"), F.lit(2)), "&"), lambda k: k != "")).alias("name")
    params = ep.select("operation", keys).distinct().groupBy("operation").agg(F.array_sort(F.collect_set("name")).alias("names"))
    listed = F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("query").alias("in")))
    return params.select("operation", F.to_json(F.struct(listed.alias("parameters"))).alias("object"))


def k18_operation_merge(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf, hashed=False).select(F.regexp_replace("operation", "\\{[a-z]+\\}", "{p}").alias("path"), "operation", "value")
    names = F.filter(F.split(F.split_part("value", F.lit("?"), F.lit(2)), "&"), lambda k: k != "")
    return ep.groupBy("path").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))), ",").alias("params"), F.count_distinct("operation").alias("operations"))


def k20_other_verbs(spark: SparkSession, sf: str) -> DataFrame:
    verb = pick(["GET", "WS", "PURGE", "POST", "EXPR"], F.col("page_id"))
    ops = endpoints(spark, sf, hashed=False).select(F.when(verb == "WS", "websocket").when(verb.isin("PURGE", "EXPR"), "other").alias("list"), F.concat_ws(" ", verb, F.regexp_replace("operation", "^[A-Z]+ ", "")).alias("operation"))
    return ops.where("list IS NOT NULL").groupBy("list").agg(F.array_join(F.array_sort(F.collect_set("operation")), "|").alias("operations"))


def l04_guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    wished = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "F").otherwise("O").alias("expected"))
    out = runs.join(wished, "o_orderkey", "left")
    done = F.coalesce(F.col("expected") == F.col("state"), F.lit(False))
    return out.select("o_orderkey", F.when(done, "done").otherwise(F.col("state")).alias("state"), done.alias("applied"))


E, L = sql.ENDPOINTS, sql.LINKS


def _by_event(values: list[str], name: str, made: str) -> str:
    return f"WITH e AS (SELECT event_id, {dealt(values)} AS x FROM events) SELECT event_id, {made} AS {name} FROM e"


_ALL_MAPS = "regexp_extract_all(x, '//# sourceMappingURL=([^ \\t\\n]+)', 1)"
_PAYLOAD = "regexp_extract(x, '^data:[^,]*?,(.*)$', 1)"
QUERIES = {
    "a07_valid_files": (a07_valid_files, "SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages WHERE url <> '' AND strlen(html) <= 1500"),
    "a08_source_map_valid": (a08_source_map_valid, _by_event(MAPS, "map", "CASE WHEN json_valid(x) THEN CASE WHEN json_type(x) = 'OBJECT' AND strlen(x) <= 30 THEN x END END")),
    "a10_engine_lines": (a10_engine_lines, f"WITH e AS (SELECT event_id, event_id % 6 AS k FROM events) SELECT event_id, unnest(['r.a', 'r.b']) AS rule, unnest(['s1', 's2']) AS snippet FROM e WHERE k = 0"),
    "a11_manifest_status": (a11_manifest_status, "WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), m AS (SELECT user_id, unnest(range(0, arg_max(k, event_id) % 4 + 1)) AS asset FROM e GROUP BY user_id), s AS (SELECT user_id, k % 4 AS asset, CASE WHEN arg_max(k, event_id) % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM e WHERE event_type = 'purchase' GROUP BY ALL) SELECT user_id, asset, coalesce(status, 'pending') AS status FROM m LEFT JOIN s USING (user_id, asset)"),
    "a17_script_dedupe": (a17_script_dedupe, "SELECT page_id % 8 AS run_id, sha256(left(coalesce(html, ''), 1200)) AS sha, min(page_id) AS page_id FROM pages GROUP BY ALL"),
    "a19_signal_fold": (a19_signal_fold, "SELECT user_id % 6 AS host, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS server, coalesce(array_to_string(list_sort(list_distinct(list('c_' || event_type) FILTER (value > 5))), ','), '') AS cookies FROM events GROUP BY 1"),
    "a27_inline_map": (a27_inline_map, _by_event(SCRIPTS, "map", "CASE event_id % 6 WHEN 0 THEN '{\"v\":3}' WHEN 3 THEN '{\"v\":3}' END")),
    "a28_external_map": (a28_external_map, _by_event(SCRIPTS, "url", f"CASE WHEN NOT starts_with({_ALL_MAPS}[-1], 'data:') THEN {_ALL_MAPS}[-1] END")),
    "a31_data_url": (a31_data_url, _by_event(DATA_URLS, "content", f"CASE WHEN regexp_matches(x, '^data:[^,]*;base64') THEN decode(from_base64({_PAYLOAD})) WHEN regexp_matches(x, '^data:[^,]*,') THEN url_decode({_PAYLOAD}) END")),
    "a32_request_metadata": (a32_request_metadata, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'text/' || event_type ELSE 'application/octet-stream' END AS content_type, CASE WHEN event_id % 3 = 1 THEN 'gzip' ELSE 'identity' END AS encoding FROM events"),
    "a33_frontier": (a33_frontier, f"WITH {L}, t AS (SELECT DISTINCT CASE WHEN regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN CASE WHEN starts_with(href, '//') THEN regexp_extract(url, {sql.URL}, 1) || ':' || href ELSE href END WHEN starts_with(href, '/') THEN regexp_extract(url, {sql.URL}, 1) || '://' || regexp_extract(url, {sql.URL}, 2) || href END AS target FROM links WHERE url IS NOT NULL) SELECT target FROM t WHERE target IS NOT NULL AND NOT regexp_matches({sql.host('target')}, '^.*\\.example\\.net$') AND target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)"),
    "a34_loaded_scripts": (a34_loaded_scripts, "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<script[^>]* src=\"([^\"]+)\"', 1)) AS script FROM pages WHERE html IS NOT NULL UNION SELECT page_id, url || '#timing.js' FROM pages WHERE html IS NOT NULL AND url IS NOT NULL"),
    "b01_tenant": (b01_tenant, f"WITH {E} SELECT page_id, operation FROM ep WHERE page_id % 2 = 1"),
    "b09_capture_scope": (b09_capture_scope, f"WITH p AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN {sql.host('url')} ELSE 'target.example' END AS host FROM pages WHERE url IS NOT NULL) SELECT page_id, host FROM p WHERE host = 'target.example' OR host = 'example.com' OR ends_with(host, '.example.com')"),
    "b16_b17_filters": (b16_b17_filters, f"WITH {E} SELECT DISTINCT operation FROM ep WHERE contains(lower(operation), '/fr')"),
    "b21_capture_gate": (b21_capture_gate, f"WITH p AS (SELECT page_id, {sql.host('url')} AS h FROM pages WHERE url IS NOT NULL) SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id % 8 = 0 ELSE h = 'example.com' OR page_id % 3 > 0 AND ends_with(h, '.example.com') END AS inside FROM p"),
    "b24_config": (b24_config, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 10 END AS limit, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'a,b' END AS denied, CASE WHEN event_id % 5 = 0 THEN 'all' ELSE 'some' END AS mode, array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'denied' END, CASE WHEN event_id % 3 = 0 THEN 'limit' END, CASE WHEN event_id % 5 = 0 THEN 'mode' END], lambda x: x IS NOT NULL), ',') AS changed FROM events".replace(" AS limit", ' AS "limit"')),
    "h25_specifier": (h25_specifier, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'src/' || event_type || '/deep/a' WHEN 1 THEN 'src/' || event_type || '/b/c' WHEN 3 THEN 'x.js' WHEN 4 THEN 'src/' || event_type || '/deep' END AS module FROM events"),
    "h26_module_key": (h26_module_key, f"SELECT page_id, coalesce(nullif(regexp_extract(url, {sql.URL}, 3), ''), url) AS key FROM pages WHERE url IS NOT NULL"),
    "h34_map_comment": (h34_map_comment, _by_event(SCRIPTS, "map", "nullif(regexp_extract(x, '(?://|/\\*)# sourceMappingURL=([^ \\t\\n*]+)', 1), '')")),
    "h35_units": (h35_units, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'recovered' WHEN 1 THEN 'none' ELSE 'failed' END AS status, unnest(CASE WHEN event_id % 3 = 0 THEN ['src/a.js', 'src/' || event_type] ELSE ['input.js'] END) AS unit FROM events"),
    "k04_correlation_stage": (k04_correlation_stage, f"WITH {E} SELECT DISTINCT finding_hash, 'capture' AS engine FROM ep WHERE run_id >= 6 AND finding_hash NOT IN (SELECT finding_hash FROM ep WHERE host IS NOT NULL AND run_id < 6)"),
    "k13_request_overlay": (k13_request_overlay, f"WITH {E}, o AS (SELECT *, split_part(operation, ' ', 2) AS p FROM ep), m AS (SELECT CASE WHEN starts_with(p, '/fr/') THEN 'GET /api' || p ELSE operation END AS operation, CASE WHEN starts_with(p, '/fr/') THEN 'api.example.com' ELSE host END AS host, CASE WHEN starts_with(p, '/fr/') THEN 'https://api.example.com' || p ELSE url END AS example FROM o) SELECT operation, coalesce(array_to_string(list_sort(list_distinct(list(host) FILTER (host IS NOT NULL))), ','), '') AS hosts, min(example) AS example FROM m GROUP BY operation"),
    "k16_operation_object": (k16_operation_object, f"WITH {E}, p AS (SELECT operation, list_sort(list_distinct(flatten(list(CASE WHEN keys <> '' THEN string_split(keys, '&') ELSE [] END)))) AS n FROM ep GROUP BY operation) SELECT operation, '{{\"parameters\":[' || coalesce(array_to_string(list_transform(n, lambda x: '{{\"name\":\"' || x || '\",\"in\":\"query\"}}'), ','), '') || ']}}' AS object FROM p"),
    "k18_operation_merge": (k18_operation_merge, f"WITH {E} SELECT regexp_replace(operation, '\\{{[a-z]+\\}}', '{{p}}', 'g') AS path, coalesce(array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN keys <> '' THEN string_split(keys, '&') ELSE [] END)))), ','), '') AS params, count(DISTINCT operation) AS operations FROM ep GROUP BY 1"),
    "k20_other_verbs": (k20_other_verbs, f"WITH {E}, o AS (SELECT {dealt(['GET', 'WS', 'PURGE', 'POST', 'EXPR'], 'page_id')} AS verb, split_part(operation, ' ', 2) AS p FROM ep), d AS (SELECT DISTINCT CASE WHEN verb = 'WS' THEN 'websocket' ELSE 'other' END AS list, verb || ' ' || p AS operation FROM o WHERE verb IN ('WS', 'PURGE', 'EXPR')) SELECT list, string_agg(operation, '|' ORDER BY operation) AS operations FROM d GROUP BY list"),
    "l04_guarded_update": (l04_guarded_update, "WITH w AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'O' END AS e FROM lineitem WHERE l_linenumber = 1) SELECT o_orderkey, CASE WHEN coalesce(e = o_orderstatus, false) THEN 'done' ELSE o_orderstatus END AS state, coalesce(e = o_orderstatus, false) AS applied FROM orders LEFT JOIN w ON l_orderkey = o_orderkey"),
}
