"""OpenAPI documents of the runs, with each page as a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import urls
from basalt.operators import documents
from basalt.plans import sql
from basalt.sources.views import table

VERBS = ["GET", "POST", "PURGE", "WS", "GET"]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each page: verbs, bodies and headers by its number."""
    n = F.col("page_id")
    pages = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", "url", urls.endpoint(F.lit("GET"), F.col("url")).alias("e"))
    keys = F.transform(F.filter(F.split(F.regexp_extract("url", "\\?([^#]*)", 1), "&"), lambda p: p != ""), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.nullif(F.split_part(p, F.lit("="), F.lit(2)), F.lit("")).alias("example")))
    method = F.element_at(F.array(*map(F.lit, VERBS)), (n % len(VERBS) + 1).cast("int"))
    path = F.concat(F.split_part("e.operation", F.lit(" "), F.lit(2)), F.when(n % 3 == 0, "/${slug}").otherwise(""))
    none = F.array().cast("array<string>")
    auth = F.when(n % 4 == 0, F.array(F.struct(F.lit("Authorization").alias("name"), F.lit("bearer").alias("scheme")))).when(n % 4 == 1, F.array(F.struct(F.lit("X Key").alias("name"), F.lit(None).cast("string").alias("scheme"))))
    body = F.when(method == "POST", F.array(F.lit("userId"), F.concat(F.lit("note"), (n % 7).cast("string")))).otherwise(none)
    hosts = F.when(F.col("e.host").isNotNull(), F.array("e.host")).otherwise(none)
    return pages.select((n % 8).alias("run"), n.alias("ord"), method.alias("method"), path.alias("path"), hosts.alias("hosts"), keys.alias("query"), body.alias("body"), F.when(n % 2 == 0, "application/json").when(n % 11 == 0, "text/plain").alias("content_type"), F.col("url").alias("example_url"), (method != "WS").alias("probeable"), auth.alias("auth"))


def k18_merged_operations(spark: SparkSession, sf: str) -> DataFrame:
    ops = documents.merged(requests(spark, sf))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    params = F.transform("parameters", lambda p: F.concat(p["place"], F.lit(":"), p["name"], F.lit("="), F.coalesce(p["example"], F.lit(""))))
    risk = F.transform("risk", lambda r: F.concat(r["name"], F.lit(":"), F.array_join(r["tags"], "+")))
    return ops.select("run", "path", "method", "requests", text(params).alias("parameters"), text("body_names").alias("body_names"), text("media_types").alias("media_types"), text(risk).alias("risk"), text("security").alias("security"))


def a25_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What each run's document says when it is read again."""
    d = documents.documents(requests(spark, sf))
    read = lambda path, kind: F.from_json(F.get_json_object("document", path), kind)
    paths = read("$.paths", "map<string, map<string, string>>")
    ops = F.aggregate(F.transform(F.map_values(paths), F.size), F.lit(0), lambda a, x: a + x).cast("long")
    listed = lambda path: F.coalesce(F.array_join(read(path, "array<string>"), ","), F.lit(""))
    return d.select("run", F.size(paths).cast("long").alias("paths"), ops.alias("operations"), F.array_join(F.transform(read("$.servers", "array<struct<url: string>>"), lambda s: s.url), ",").alias("servers"), listed("$.x-basalt-websocket-endpoints").alias("sockets"), listed("$.x-basalt-other-operations").alias("others"), F.array_join(F.map_keys(read("$.components.securitySchemes", "map<string, string>")), ",").alias("schemes"))


Q = f"""u AS (SELECT page_id AS ord, page_id % 8 AS run, url, {sql.host('url')} AS host, {sql.template_path(f'regexp_extract(url, {sql.URL}, 3)')} || CASE WHEN page_id % 3 = 0 THEN '/{{slug}}' ELSE '' END AS path, ['get', 'post', 'purge', 'ws', 'get'][CAST(page_id % 5 AS BIGINT) + 1] AS method,
  list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '') AS keys, CASE WHEN page_id % 2 = 0 THEN 'application/json' WHEN page_id % 11 = 0 THEN 'text/plain' END AS type FROM pages WHERE url IS NOT NULL),
o AS (SELECT run, path, method, count(*) AS requests FROM u WHERE method IN ('get', 'post') GROUP BY ALL),
p AS (SELECT run, path, method, 'path:' || unnest(regexp_extract_all(path, '\\{{([^}}]*)\\}}', 1)) || '=' AS p, (0, ord, 0) AS spot, split_part(p, '=', 1) AS n FROM u UNION ALL
  SELECT run, path, method, 'query:' || split_part(k, '=', 1) || '=' || split_part(k, '=', 2), (1, ord, i), 'query:' || split_part(k, '=', 1) FROM (SELECT *, unnest(keys) AS k, unnest(range(len(keys))) AS i FROM u)),
p1 AS (SELECT run, path, method, n, arg_min(p, spot) AS p, min(spot) AS spot, any_value(position(n[6:] IN path)) AS place FROM p GROUP BY run, path, method, n),
p2 AS (SELECT run, path, method, string_agg(p, ',' ORDER BY spot[1], CASE WHEN spot[1] = 0 THEN place END, spot) AS parameters FROM p1 GROUP BY ALL),
b AS (SELECT run, path, method, string_agg(DISTINCT n, ',' ORDER BY n) AS sorted, 'userId,note' || CAST(min(ord) % 7 AS VARCHAR) AS own, coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') AS media_types FROM (SELECT *, unnest(['userId', 'note' || CAST(ord % 7 AS VARCHAR)]) AS n FROM u WHERE method = 'post') GROUP BY ALL),
s AS (SELECT run, path, method, string_agg(DISTINCT CASE ord % 4 WHEN 0 THEN 'bearerAuth' ELSE 'X_Key' END, ',' ORDER BY CASE ord % 4 WHEN 0 THEN 'bearerAuth' ELSE 'X_Key' END) AS security FROM u WHERE ord % 4 < 2 GROUP BY ALL)"""
K18 = f"WITH {Q} SELECT o.run, o.path, o.method, o.requests, coalesce(p2.parameters, '') AS parameters, coalesce(CASE WHEN o.requests > 1 THEN b.sorted ELSE b.own END, '') AS body_names, coalesce(b.media_types, '') AS media_types, CASE WHEN b.own IS NOT NULL THEN 'userId:idor' ELSE '' END AS risk, coalesce(s.security, '') AS security FROM o LEFT JOIN p2 USING (run, path, method) LEFT JOIN b USING (run, path, method) LEFT JOIN s USING (run, path, method)"
A25 = f"""WITH {Q}, x AS (SELECT run, count(DISTINCT path) AS paths, count(*) AS operations FROM o GROUP BY run), w AS (SELECT run, string_agg(DISTINCT 'WS ' || url, ',' ORDER BY 'WS ' || url) AS sockets FROM u WHERE method = 'ws' GROUP BY run), n AS (SELECT run, string_agg(DISTINCT 'PURGE ' || url, ',' ORDER BY 'PURGE ' || url) AS others FROM u WHERE method = 'purge' GROUP BY run),
h AS (SELECT run, host, arg_max(lower(regexp_extract(url, {sql.URL}, 1)), ord) || '://' || host AS url FROM u WHERE host <> '' AND method <> 'ws' GROUP BY run, host), v AS (SELECT run, string_agg(DISTINCT url, ',' ORDER BY url) AS servers FROM h GROUP BY run),
c AS (SELECT run, string_agg(DISTINCT k, ',' ORDER BY k) AS schemes FROM (SELECT run, unnest(string_split(security, ',')) AS k FROM s WHERE method IN ('get', 'post')) GROUP BY run)
SELECT r.run, coalesce(paths, 0) AS paths, coalesce(operations, 0) AS operations, servers, coalesce(sockets, '') AS sockets, coalesce(others, '') AS others, schemes FROM (SELECT DISTINCT run FROM u) r LEFT JOIN x USING (run) LEFT JOIN w USING (run) LEFT JOIN n USING (run) LEFT JOIN v USING (run) LEFT JOIN c USING (run)"""

QUERIES = {"k18_merged_operations": (k18_merged_operations, K18), "a25_documents": (a25_documents, A25)}
