"""The findings of the runs, which the pages' links stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import urls
from basalt.operators import views
from basalt.plans import sql
from basalt.plans.labels import dealt, pick
from basalt.sources.views import links, table

KINDS = ["endpoint", "endpoint_generic", "page_route", "secret"]


def read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(findings, occurrences): every distinct link of a run is a finding; sessions and engagements by the run's number."""
    rows = links(spark, sf).where("url IS NOT NULL").select("page_id", "run_id", F.nullif(urls.host(F.col("url")), F.lit("")).alias("host"), F.col("ordinal").cast("long").alias("k"), "href")
    name = F.sha2(F.col("href").cast("binary"), 256)
    findings = rows.select(F.col("run_id").alias("run"), name.alias("finding_hash"), pick(KINDS, F.length("href")).alias("type"), F.col("href").alias("value"), F.left("href", F.lit(2)).alias("path")).distinct()
    n = F.col("page_id") + F.col("k")
    asset = F.when(n % 3 > 0, F.col("page_id"))
    occurrences = rows.select(F.col("run_id").alias("run"), name.alias("finding_hash"), "host", F.when(n % 4 > 0, F.concat(F.lit("src/"), (n % 4).cast("string"))).alias("source_path"), F.when(n % 5 > 0, F.col("k")).alias("offset_start"), (F.col("k") + 1).alias("offset_end"), F.col("href").alias("evidence"), (F.col("page_id") * 100 + F.col("k")).alias("occurrence_hash"), asset.alias("asset"))
    run = F.col("id")
    runs = spark.range(8).select(run.alias("run"), (run % 3).alias("session"), F.when(run < 6, run % 2).alias("engagement"), F.when(run % 4 < 2, "capture").otherwise("platform").alias("origin"), F.when(run % 2 == 0, "r").alias("input_ref"))
    assets = table(spark, sf, "pages").where("url IS NOT NULL").select((F.col("page_id") % 8).alias("run"), F.col("page_id").alias("asset"), "url", F.when(F.col("page_id") % 7 > 2, "blob").alias("input_ref"))
    given = findings.select((F.col("run") % 3).alias("session"), "finding_hash", "value").distinct()
    triage = given.where(F.length("value") % 3 == 0).select("session", "finding_hash", F.when(F.col("session") == 0, "confirmed").otherwise("dismissed").alias("status"))
    verdicts = given.where(F.length("value") % 2 == 0).select("session", "finding_hash", F.lit("shadow").alias("status"), F.lit("undocumented-path").alias("reason"), F.concat(F.lit("GET "), "value").alias("matched"))
    seen = views.occurrence_view(findings, occurrences, runs, assets)
    return views.findings_view(findings, seen, triage, verdicts, runs), seen


def o01_findings(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = read(spark, sf)
    return found.select("run", "place", "type", "value", "triage", "class", "matched", "sightings_capture", "sightings_platform", "revealable", "occurrences", F.array_join("hosts", ",").alias("hosts"))


def o01_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    _, seen = read(spark, sf)
    return seen.select("run", "finding_hash", "place", "host", "source_path", "offset_start", "evidence", "asset_url", "readable")


def b13_visible(spark: SparkSession, sf: str) -> DataFrame:
    """Four facets at once and a text; each has two values or more in the tables."""
    found, _ = read(spark, sf)
    hosts = found.select(F.explode("hosts").alias("h")).groupBy("h").count().orderBy(F.desc("count"), "h").limit(20).select("h")  # the twenty largest of the report
    chosen = [r.h for r in hosts.collect()]
    shown = views.visible(found, {"type": ["endpoint", "page_route", "secret"], "class": [views.UNCLASSIFIED, "shadow"], "triage": ["confirmed", views.UNTRIAGED], "host": chosen}, "E")
    return shown.select("run", "value", "type")


def d20_facets_of_findings(spark: SparkSession, sf: str) -> DataFrame:
    return views.facet_counts(read(spark, sf)[0])


V = f"""{sql.LINKS},
r AS (SELECT page_id, run_id AS run, nullif({sql.host('url')}, '') AS host, url, CAST(ordinal AS BIGINT) AS k, href, page_id + ordinal AS n FROM links WHERE url IS NOT NULL),
f AS (SELECT DISTINCT run, sha256(href) AS finding_hash, {dealt(KINDS, 'length(href)')} AS type, href AS value, run % 3 AS session, CASE WHEN run < 6 THEN run % 2 END AS engagement, CASE WHEN run % 4 < 2 THEN 'capture' ELSE 'platform' END AS origin FROM r),
o AS (SELECT r.run, sha256(href) AS finding_hash, host, href, CASE WHEN n % 4 > 0 THEN 'src/' || CAST(n % 4 AS VARCHAR) END AS source_path, CASE WHEN n % 5 > 0 THEN k END AS offset_start, page_id * 100 + k AS oh, CASE WHEN n % 3 > 0 THEN url END AS asset_url, n % 5 > 0 AND CASE WHEN n % 3 > 0 THEN page_id % 7 > 2 ELSE run % 2 = 0 END AS readable FROM r),
c AS (SELECT run, finding_hash, count(*) AS occurrences, bool_or(readable) AS readable, list_sort(list_distinct(list(host) FILTER (host IS NOT NULL))) AS hosts FROM o GROUP BY ALL),
s AS (SELECT a.run, a.finding_hash, count(b.run) FILTER (b.origin = 'capture') AS sc, count(b.run) FILTER (b.origin = 'platform') AS sp FROM f a LEFT JOIN f b ON b.engagement = a.engagement AND b.finding_hash = a.finding_hash AND b.run <> a.run WHERE a.engagement IS NOT NULL GROUP BY ALL),
view_ AS (SELECT f.run, row_number() OVER (PARTITION BY f.run ORDER BY type, value, f.finding_hash) AS place, type, value, left(value, 2) AS path, CASE WHEN length(value) % 3 = 0 THEN CASE WHEN session = 0 THEN 'confirmed' ELSE 'dismissed' END END AS triage, CASE WHEN length(value) % 2 = 0 THEN 'shadow' END AS class, CASE WHEN length(value) % 2 = 0 THEN 'GET ' || value END AS matched, sc AS sightings_capture, sp AS sightings_platform, type = 'secret' AND readable AS revealable, occurrences, hosts FROM f JOIN c USING (run, finding_hash) LEFT JOIN s USING (run, finding_hash))"""
O1 = f"WITH {V} SELECT run, place, type, value, triage, class, matched, sightings_capture, sightings_platform, revealable, occurrences, coalesce(array_to_string(hosts, ','), '') AS hosts FROM view_"
O1_SEEN = f"WITH {V} SELECT o.run, o.finding_hash, row_number() OVER (PARTITION BY o.run, o.finding_hash ORDER BY coalesce(source_path, ''), coalesce(offset_start, 0), oh) AS place, host, source_path, offset_start, CASE WHEN f.type <> 'secret' THEN href END AS evidence, asset_url, readable FROM o JOIN f USING (run, finding_hash)"
B13 = f"WITH {V}, top AS (SELECT h FROM (SELECT unnest(hosts) AS h FROM view_) GROUP BY h ORDER BY count(*) DESC, h LIMIT 20) SELECT run, value, type FROM view_ WHERE type IN ('endpoint', 'page_route', 'secret') AND coalesce(triage, 'untriaged') IN ('confirmed', 'untriaged') AND EXISTS (SELECT 1 FROM top WHERE list_contains(hosts, h)) AND contains(lower(concat_ws(' ', value, path, matched, array_to_string(hosts, ' '))), 'e')"
D20 = f"WITH {V}, p AS (SELECT 'type' AS facet, type AS value FROM view_ UNION ALL SELECT 'class', coalesce(class, 'unclassified') FROM view_ UNION ALL SELECT 'triage', coalesce(triage, 'untriaged') FROM view_ UNION ALL SELECT 'host', unnest(hosts) FROM view_) SELECT facet, value, count(*) AS n FROM p GROUP BY ALL"

QUERIES = {"o01_findings": (o01_findings, O1), "o01_occurrences": (o01_occurrences, O1_SEEN), "b13_visible": (b13_visible, B13), "d20_facets_of_findings": (d20_facets_of_findings, D20)}
