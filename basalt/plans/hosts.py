"""Host inventories from six sources, and requests as artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import artifacts
from basalt.operators import hosts
from basalt.plans import documents, sql
from basalt.plans.labels import dealt, pick
from basalt.plans.scans import SCOPE, SUFFIXES
from basalt.sources.views import links, table

KINDS = ["endpoint", "endpoint_generic", "endpoint_unresolved", "page_route", "secret"]


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = links(spark, sf)
    return rows.select(F.col("run_id").alias("run"), pick(KINDS, F.length("href")).alias("type"), F.when((F.col("page_id") + F.col("ordinal")) % 3 > 0, F.col("url")).alias("host"), F.col("href").alias("finding_hash"))


def d12_hosts_of_six_sources(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 8).alias("run"), "url")
    assets = pages.where("page_id % 2 = 0 OR page_id % 3 = 0").select("run", "url")
    technologies = pages.select("run", F.upper(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    base = F.concat(F.lit("https://"), F.lit("api."), F.regexp_extract("url", "([a-z]+[.](?:com|org|net))", 1), F.lit(":8443/v1"))
    return hosts.inventory(assets, _occurrences(spark, sf), technologies, pages.select("run", base.alias("base_url")), SCOPE, SUFFIXES)


def d12_unattributed(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.unattributed(_occurrences(spark, sf))


def g37_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's request as a curl command and as raw HTTP; every third without its URL, every sixth without hosts."""
    r = documents.requests(spark, sf).where("probeable")
    n = F.col("ord")
    example, found = F.when(n % 3 > 0, F.col("example_url")), F.when(n % 6 > 0, F.concat("hosts", F.array(F.lit("b'.io"), F.lit("c.io")))).otherwise(F.array().cast("array<string>"))
    operation = F.concat("method", F.lit(" "), "path")
    given = (example, F.col("path"), found, F.col("content_type"), F.col("body"))
    return r.select(n.alias("page_id"), artifacts.curl(operation, F.col("method"), *given).alias("curl"), artifacts.raw_http(F.col("method"), *given).alias("http"))


O = f"{sql.LINKS}, o AS (SELECT run_id AS run, {dealt(KINDS, 'length(href)')} AS type, CASE WHEN (page_id + ordinal) % 3 > 0 THEN {sql.host('url')} ELSE '' END AS host, href FROM links), l AS (SELECT run, CASE type WHEN 'endpoint' THEN 'endpoints' WHEN 'page_route' THEN 'routes' ELSE 'suspected' END AS lane, host, href FROM o WHERE type <> 'secret')"
D12 = f"""WITH {O}, p AS (SELECT page_id, page_id % 8 AS run, url, {sql.host('url')} AS host FROM pages WHERE url IS NOT NULL),
x AS (SELECT run, host, 'assets' AS s, CAST(NULL AS VARCHAR) AS i FROM p WHERE page_id % 2 = 0 OR page_id % 3 = 0 UNION ALL SELECT run, host, 'techs', NULL FROM p UNION ALL SELECT run, host, lane, href FROM l UNION ALL SELECT run, 'api.' || regexp_extract(url, '([a-z]+[.](?:com|org|net))', 1), 'declared', NULL FROM p)
SELECT run, host, bool_or(s = 'declared') AS declared, count(*) FILTER (s = 'assets') AS assets, count(DISTINCT i) FILTER (s = 'endpoints') AS endpoints, count(DISTINCT i) FILTER (s = 'suspected') AS suspected, count(DISTINCT i) FILTER (s = 'routes') AS routes, count(*) FILTER (s = 'techs') AS techs,
host = 'ththth.example.net' OR ends_with(host, '.ththth.example.net') OR host = 'example.com' OR ends_with(host, '.example.com') AS in_scope FROM x WHERE host <> '' GROUP BY run, host"""
D12_UN = f"WITH {O}, e AS (SELECT run, lane, href, bool_or(host <> '') AS known FROM l GROUP BY ALL) SELECT run, lane, count(*) AS findings, count(*) FILTER (NOT known) AS unattributed FROM e GROUP BY ALL"
_BODY = """CASE WHEN method = 'post' THEN '{{"userId":"<userId>","note' || k || '":"<note' || k || '>"}}' END"""
G37 = f"""WITH {documents.Q}, given AS (SELECT *, CAST(ord % 7 AS VARCHAR) AS k, upper(method) AS verb, replace(path, '/{{slug}}', '/${{slug}}') AS raw, ord % 3 > 0 AS whole, ord % 6 > 0 AS hosted, regexp_extract(url, '://([^/?#]+)', 1) AS netloc, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM u WHERE method <> 'ws'),
made AS (SELECT *, {_BODY.format()} AS body, CASE WHEN whole THEN lower(regexp_extract(url, '^([^:]*):', 1)) || '://' || netloc WHEN hosted THEN 'https://' || coalesce(nullif(host, ''), 'b''.io') ELSE '{{{{base_url}}}}' END AS base, CASE WHEN whole THEN (CASE WHEN p = '' THEN '/' ELSE p END) || CASE WHEN q <> '' THEN '?' || q ELSE '' END ELSE raw END AS origin FROM given)
SELECT ord AS page_id, '# ' || verb || ' ' || raw || CASE WHEN hosted THEN '  (host: ' || coalesce(nullif(host, ''), 'b''.io') || ')' ELSE '  (host unknown)' END || chr(10) || '# add auth/headers here' || chr(10) || 'curl -X ' || verb || ' ''' || replace(base || origin, '''', '''\\''''') || '''' || coalesce(' \\' || chr(10) || '  -H ''Content-Type: ' || type || '''', '') || coalesce(' \\' || chr(10) || '  --data ''' || body || '''', '') || CASE WHEN hosted THEN chr(10) || '# other hosts: ' || CASE WHEN host <> '' THEN 'b''.io, c.io' ELSE 'c.io' END ELSE '' END AS curl,
verb || ' ' || origin || ' HTTP/1.1' || chr(10) || 'Host: ' || CASE WHEN whole THEN netloc WHEN hosted THEN coalesce(nullif(host, ''), 'b''.io') ELSE 'HOST' END || chr(10) || '# add auth/headers here' || chr(10) || coalesce('Content-Type: ' || type || chr(10), '') || chr(10) || coalesce(body, '') AS http FROM made"""

QUERIES = {"d12_hosts_of_six_sources": (d12_hosts_of_six_sources, D12), "d12_unattributed": (d12_unattributed, D12_UN), "g37_artifacts": (g37_artifacts, G37)}
