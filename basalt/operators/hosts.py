"""The hosts of runs, from six sources, counted in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import scope, urls

#: Kinds of findings by lane; other kinds belong to none.
LANES = {"endpoint": "endpoints", "endpoint_generic": "suspected", "endpoint_unresolved": "suspected", "page_route": "routes"}


def host_of(value: Column) -> Column:
    """The host in a URL or a bare host, normalized; empty if there is none."""
    bare = F.regexp_extract(value, "^([^/?#]*)", 1)
    named = F.when(F.contains(value, F.lit("://")), urls.host(value)).otherwise(F.regexp_replace(F.regexp_replace(bare, "^.*@", ""), ":[0-9]*$", ""))
    return F.coalesce(scope.normalize_host(named), F.lit(""))


def _lane(kind: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for item in LANES.items() for x in item))
    return F.try_element_at(pairs, kind)


def _tagged(rows: DataFrame, source: Column, value: Column, item: Column) -> DataFrame:
    return rows.select("run", source.alias("source"), host_of(value).alias("host"), item.cast("string").alias("item"))


def inventory(assets: DataFrame, occurrences: DataFrame, technologies: DataFrame, declared: DataFrame, scope_hosts: list[str], public_suffixes: list[str]) -> DataFrame:
    """run, host, in_scope, declared, assets, endpoints, suspected, routes, techs of every host of the six sources.

    assets: run, url (http and https count). occurrences: run, type, host, finding_hash (a finding counts once for
    each of its hosts, in its lane). technologies: run, host. declared: run, base_url. What has no host is left out.
    """
    web = assets.where(F.lower("url").rlike("^https?://"))
    none = F.lit(None)
    rows = [
        _tagged(web, F.lit("assets"), F.col("url"), none),
        _tagged(occurrences.where(F.col("type").isin(*LANES)), _lane(F.col("type")), F.col("host"), F.col("finding_hash")),
        _tagged(technologies, F.lit("techs"), F.col("host"), none),
        _tagged(declared, F.lit("declared"), F.col("base_url"), none),
    ]
    # rows of one source, host and finding become one before hosts are counted
    once = reduce(DataFrame.unionByName, rows).where("host <> ''").groupBy("run", "host", "source", "item").agg(F.count(F.lit(1)).alias("n"))
    total = lambda name, value: F.sum(F.when(F.col("source") == name, value).otherwise(0)).cast("long").alias(name)
    counted = once.groupBy("run", "host").agg((F.count_if(F.col("source") == "declared") > 0).alias("declared"), total("assets", F.col("n")), *(total(lane, F.lit(1)) for lane in dict.fromkeys(LANES.values())), total("techs", F.col("n")))
    return counted.withColumn("in_scope", scope.in_scope(F.col("host"), scope_hosts, public_suffixes))


def unattributed(occurrences: DataFrame) -> DataFrame:
    """run, lane, findings, unattributed (findings of which no occurrence has a host)."""
    rows = occurrences.where(F.col("type").isin(*LANES)).select("run", _lane(F.col("type")).alias("lane"), "finding_hash", (host_of(F.col("host")) != "").alias("known"))
    each = rows.groupBy("run", "lane", "finding_hash").agg(F.max("known").alias("known"))
    return each.groupBy("run", "lane").agg(F.count(F.lit(1)).alias("findings"), F.count_if(~F.col("known")).alias("unattributed"))
