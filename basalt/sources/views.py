"""The driver's tables in the roles of an inventory's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import identity, urls

RUNS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.pmod("page_id", F.lit(RUNS)).alias("run_id"), "url", F.col("html").alias("content"))


def endpoints(spark: SparkSession, sf_dir: str, hashed: bool = True) -> DataFrame:
    """Each page as an observed GET: run_id, page_id, operation, value, host and, unless not hashed, finding_hash.

    The hash of values beyond plain ASCII takes a join that no plan can leave out, so it is only added where used.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url").where("url IS NOT NULL")
    rows = pages.select("page_id", "url", F.pmod("page_id", F.lit(RUNS)).alias("run_id"), urls.endpoint(F.lit("GET"), F.col("url")).alias("e"))
    rows = rows.select("page_id", "url", "run_id", "e.operation", "e.value", "e.host")
    return identity.with_finding_hash(rows, F.lit("endpoint"), "value") if hashed else rows


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every href of every page: page_id, run_id, url, ordinal, href."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ordinal", "href")
    return table(spark, sf_dir, "pages").select("page_id", F.pmod("page_id", F.lit(RUNS)).alias("run_id"), "url", found)
