"""API descriptions of the pages' hosts: one body for each host, made of its pages, in eight forms by the host's length.

0 servers with variables, 1 Swagger with a base path, 2 no servers, 3 an external reference, 4 references in a
circle, 5 cut short, 6 a chain of references that ends, 7 no version key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import urls
from basalt.operators import correlate
from basalt.plans import models, sql
from basalt.sources import specs
from basalt.sources.views import endpoints, table

INFO = '"info":{"title":"t","version":"1"},'
HEADS = [
    '{"openapi":"3.0.3",' + INFO + '"servers":[{"url":"https://{env}.example.com/v{n}","variables":{"env":{"default":"api"},"n":{"default":2}}},{"url":"/alt?x=1"}],',
    '{"swagger":"2.0",' + INFO + '"basePath":"/base",',
    '{"openapi":"3.0.3",' + INFO,
    '{"openapi":"3.0.3",' + INFO + '"x":{"$ref":"https://elsewhere.example/s.json#/a"},',
    '{"openapi":"3.0.3",' + INFO + '"c":{"a":{"$ref":"#/c/b"},"b":{"$ref":"#/c/d~1e"},"d/e":{"$ref":"#/c/b"}},',
    '{"openapi":"3.0.3",' + INFO + '"tail":[',
    '{"openapi":"3.0.3",' + INFO + '"servers":[{"url":"https://only.example"}],"c":{"a":{"$ref":"#/c/b"},"b":{"$ref":"#/c/d"},"d":{"type":"string"}},',
    "{" + INFO,
]
REASONS = ["NULL", "NULL", "NULL", "'external $ref'", "'circular $ref'", "'not JSON or YAML'", "NULL", "'unrecognized'"]


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """spec_id (host), body: paths by their first page, with an operation to read and, for some, one to write."""
    pages = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", urls.host(F.col("url")).alias("host"), urls.part(F.col("url"), urls.PATH).alias("path")).where("host <> ''")
    paths = pages.groupBy("host", "path").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    item = F.when(F.length("path") % 2 == 0, F.lit('{"parameters":[],"get":{"responses":{}},"x-own":1,"post":{"responses":{}}}')).otherwise(F.lit('{"get":{"responses":{}}}'))
    entries = F.array_sort(F.collect_list(F.struct("first", "path", item.alias("item"))))
    made = paths.groupBy("host").agg(entries.alias("e"))
    text = F.concat(F.lit('"paths":{'), F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), F.replace(F.replace(x.path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'), x.item)), ","), F.lit("}}"))
    form = F.pmod(F.length("host"), F.lit(8))
    head = F.element_at(F.array(*map(F.lit, HEADS)), (form + 1).cast("int"))
    return made.select(F.col("host").alias("spec_id"), F.concat(head, text).alias("body"))


def a22_spec_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return specs.verdicts(specs.looked_at(bodies(spark, sf))).select("spec_id", "format", "reason")


def a24_documented_operations(spark: SparkSession, sf: str) -> DataFrame:
    found = specs.documented(specs.verdicts(specs.looked_at(bodies(spark, sf))))
    place = F.concat_ws(".", "ord.p", "ord.m", "ord.b")
    return found.select("spec_id", place.alias("place"), "method", "path")


def a24_classified(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' operations against all documented ones, in the order of hosts and documents."""
    found = specs.documented(specs.verdicts(specs.looked_at(bodies(spark, sf))))
    rows = found.select(F.struct("spec_id", "ord").alias("ord"), "operation")
    return correlate.classify(endpoints(spark, sf, hashed=False).select("operation"), rows)


FORM = "length(spec_id) % 8"
H = f"""h AS (SELECT page_id, {sql.host('url')} AS spec_id, regexp_extract(url, {sql.URL}, 3) AS path FROM pages WHERE url IS NOT NULL),
f AS (SELECT spec_id, path, min(page_id) AS first FROM h WHERE spec_id <> '' GROUP BY ALL),
qq AS (SELECT spec_id, path, row_number() OVER (PARTITION BY spec_id ORDER BY first) - 1 AS p FROM f WHERE {FORM} IN (0, 1, 2, 6)),
mm AS (SELECT spec_id, path, p, unnest(CASE WHEN length(path) % 2 = 0 THEN [1, 3] ELSE [0] END) AS m FROM qq),
bb AS (SELECT spec_id, path, p, m, unnest(CASE {FORM} WHEN 0 THEN ['/v2', '/alt'] WHEN 1 THEN ['/base'] ELSE [''] END) AS base, unnest(CASE {FORM} WHEN 0 THEN [0, 1] ELSE [0] END) AS b FROM mm),
ops AS (SELECT spec_id, p, m, b, CASE m WHEN 3 THEN 'POST' ELSE 'GET' END AS method, base || path AS path FROM bb)"""
A22 = f"WITH {H} SELECT DISTINCT spec_id, CASE WHEN {FORM} IN (3, 4, 5, 7) AND {FORM} <> 4 THEN NULL WHEN {FORM} = 1 THEN 'swagger-2' ELSE 'openapi-3' END AS format, CASE {FORM} " + " ".join(f"WHEN {k} THEN {r}" for k, r in enumerate(REASONS)) + " END AS reason FROM f"
A24 = f"WITH {H} SELECT spec_id, concat_ws('.', p, m, b) AS place, method, path FROM ops"
DOCS = f"d AS (SELECT row_number() OVER (ORDER BY spec_id, p, m, b) AS ord, method || ' ' || path AS doc, method, {models._SEGS.replace('operation', 'path')} AS segs FROM ops)"
CLASSIFIED = models.CLASSIFY.replace(models.CLASSIFY[models.CLASSIFY.index("d AS (SELECT ord") : models.CLASSIFY.index("\nm AS (SELECT")], f"{H},\n{DOCS},") + " SELECT * FROM verdict"

QUERIES = {"a22_spec_verdicts": (a22_spec_verdicts, A22), "a24_documented_operations": (a24_documented_operations, A24), "a24_classified": (a24_classified, CLASSIFIED)}
