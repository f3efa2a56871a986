"""First candidates that resolve, and versioned changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import candidates, upserts
from basalt.sources.views import links, table


def g26_reveal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each link's word as a finding; its sightings resolve if a page of that number has an .org address."""
    rows = links(spark, sf).select(F.col("href").alias("finding_hash"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("src/"), (F.col("page_id") % 7).cast("string"))).alias("source_path"), F.when(F.col("ordinal") % 4 > 0, F.col("ordinal").cast("long") * 10).alias("offset_start"), (F.col("ordinal") * 10 + 5).cast("long").alias("offset_end"), (F.col("page_id") * 100 + F.col("ordinal")).alias("occurrence_hash"), F.col("page_id").alias("input_ref"))
    blobs = table(spark, sf, "pages").where(F.contains("url", F.lit(".org"))).select(F.col("page_id").alias("ref"))
    found, _ = candidates.reveal_candidates(rows, blobs)
    return found.select("finding_hash", "occurrence_hash", "input_ref", "resolved")


def _changes(spark: SparkSession, sf: str, batch: str, flag: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
    return lines.select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("state"), F.when(F.col("l_linenumber") < 3, 1).otherwise(2).cast("long").alias("expected"), F.col("l_linenumber").cast("long").alias("ord"), F.lit(batch).alias("batch"))


def l04_versioned_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Orders after two batches of lines, each based on a version, and the first batch once more."""
    now = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.lit(1).cast("long").alias("version"), F.lit("load").alias("batch"))
    for batch, flag in (("b1", "R"), ("b2", "A"), ("b1", "R")):
        now = upserts.merged(now, _changes(spark, sf, batch, flag), ["o_orderkey"], ["state"])
    return now


G26 = """WITH l0 AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages), l AS (SELECT page_id, unnest(range(len(hrefs))) AS k, unnest(hrefs) AS href FROM l0),
o AS (SELECT href, page_id * 100 + k AS occurrence_hash, page_id AS ref, page_id IN (SELECT page_id FROM pages WHERE contains(url, '.org')) AS ok, (CASE WHEN page_id % 3 > 0 THEN 'src/' || CAST(page_id % 7 AS VARCHAR) ELSE '' END, k * 10, page_id * 100 + k) AS place FROM l WHERE k % 4 > 0)
SELECT href AS finding_hash, arg_min(occurrence_hash, (NOT ok, place)) AS occurrence_hash, arg_min(ref, place) FILTER (ok) AS input_ref, bool_or(ok) AS resolved FROM o GROUP BY href"""
_BATCH = "(SELECT l_orderkey AS k, arg_min(l_returnflag || l_linestatus, (l_linenumber, l_linestatus)) AS s, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = '{}' GROUP BY l_orderkey)"
# the first line of a batch decides; a replay finds its own batch, or another one's version that it was not based on
L04 = f"""WITH a AS {_BATCH.format("R")}, b AS {_BATCH.format("A")},
x AS (SELECT o_orderkey, o_orderstatus AS s0, CASE WHEN a.n < 3 THEN a.s END AS s1 FROM orders LEFT JOIN a ON a.k = o_orderkey),
y AS (SELECT x.*, CASE WHEN s1 IS NULL AND b.n < 3 OR s1 IS NOT NULL AND b.n >= 3 THEN b.s END AS s2 FROM x LEFT JOIN b ON b.k = o_orderkey),
z AS (SELECT y.*, CASE WHEN a.n >= 3 AND (s1 IS NULL AND s2 IS NOT NULL) THEN a.s END AS s3 FROM y LEFT JOIN a ON a.k = o_orderkey)
SELECT o_orderkey, coalesce(s3, s2, s1, s0) AS state, CAST(1 + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS BIGINT) AS version, CASE WHEN s3 IS NOT NULL THEN 'b1' WHEN s2 IS NOT NULL THEN 'b2' WHEN s1 IS NOT NULL THEN 'b1' ELSE 'load' END AS batch FROM z"""

QUERIES = {"g26_reveal_candidates": (g26_reveal_candidates, G26), "l04_versioned_merge": (l04_versioned_merge, L04)}
