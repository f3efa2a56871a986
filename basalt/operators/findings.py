"""Findings and their sightings: merge, roll-up, coverage, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unanimous(column: str) -> Column:
    """The value all rows of a group have; null if they differ or one has none."""
    same = (F.count_distinct(column) == 1) & (F.count(column) == F.count(F.lit(1)))
    return F.when(same, F.min(column))


def first_known(column: str, order: Column) -> Column:
    """The first value that is not null, in the order given."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(order.alias("o"), F.col(column).alias("v"))))["v"]


def merge_findings(rows: DataFrame, keys: list[str], ordinal: str, scalars: list[str], unions: list[str], agreed: list[str]) -> DataFrame:
    """One row for each key: lists are united and sorted, agreed attributes kept if unanimous, other scalars from the first writer that has one.

    Every aggregate has partial sums of bounded size except the united lists, which hold distinct values only.
    """
    order = F.col(ordinal)
    aggs = [first_known(c, order).alias(c) for c in scalars]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array()))))).alias(c) for c in unions]
    aggs += [unanimous(c).alias(c) for c in agreed]
    return rows.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("sightings"))


def dedupe_occurrences(rows: DataFrame, identity: list[str], ordinal: str, carried: list[str]) -> DataFrame:
    """The first row of each identity keeps its carried columns. Identity nulls are equal to each other, as in a hash of all fields."""
    first = F.min(F.struct(ordinal, *carried)).alias("first")
    return rows.groupBy(*identity).agg(first, F.count(F.lit(1)).alias("copies")).select(*identity, *(F.col(f"first.{c}") for c in carried), "copies")


def host_rollup(rows: DataFrame, host: str, finding: str, lane: str, lanes: list[str]) -> DataFrame:
    """Distinct findings of each lane for each host; a finding on two hosts counts for both."""
    return rows.where(F.col(host).isNotNull()).groupBy(host).agg(*(F.count_distinct(F.when(F.col(lane) == x, F.col(finding))).alias(f"n_{x}") for x in lanes))


def unattributed(rows: DataFrame, host: str, finding: str) -> DataFrame:
    """Findings none of whose sightings has a host."""
    return rows.groupBy(finding).agg(F.max(F.col(host).isNotNull()).alias("seen")).where("NOT seen").select(finding)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded half to even; null where there is nothing to count."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 0).cast("long"))


def coverage(events: DataFrame, run: str, order: str, sums: list[str], any_of: list[str], last: list[str], several: Column) -> DataFrame:
    """Counts of a run: all its events added up, or the last event alone where the run has one asset only; `last` fields always from the highest order."""
    total = [F.sum(c).alias(f"{c}_sum") for c in sums]
    top = [F.max_by(c, order).alias(f"{c}_last") for c in [*sums, *last]]
    flags = [F.bool_or(c).alias(c) for c in any_of]
    out = events.groupBy(run).agg(*total, *top, *flags, F.max(several).alias("several"))
    chosen = [F.when(F.col("several"), F.col(f"{c}_sum")).otherwise(F.col(f"{c}_last")).alias(c) for c in sums]
    return out.select(run, *chosen, *any_of, *(F.col(f"{c}_last").alias(c) for c in last))


def overlay(findings: DataFrame, overlays: list[tuple[DataFrame, list[str], dict[str, object]]]) -> DataFrame:
    """Left joins of verdict tables; absent rows give the stated default (None: null)."""
    out = findings
    for table, keys, defaults in overlays:
        out = out.join(table, keys, "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None})
    return out


def sightings(findings: DataFrame, run: str, group: str, finding: str, origin: str, origins: list[str]) -> DataFrame:
    """For each run's finding, the other runs of the group that have it, by origin. Counted once for each group and finding, so no pair of runs is formed."""
    mine = findings.select(run, group, finding, origin).distinct()
    totals = mine.groupBy(group, finding).agg(*(F.count_if(F.col(origin) == o).alias(f"all_{o}") for o in origins))
    out = mine.join(totals, [group, finding])
    return out.select(run, finding, *((F.col(f"all_{o}") - F.when(F.col(origin) == o, 1).otherwise(0)).alias(f"from_{o}") for o in origins))


def prefix_rollup(rows: DataFrame, path: str, amount: str) -> DataFrame:
    """Sums at and under every directory of a path: each row counts for all its prefixes."""
    parts = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return rows.where(F.size(parts) > 0).select(F.explode(prefixes).alias("prefix"), F.col(amount).alias("amount")).groupBy("prefix").agg(F.sum("amount").alias("total"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each facet, from one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return rows.select(pairs).where("x.value IS NOT NULL").groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def run_diff(before: DataFrame, after: DataFrame, key: str, complete: bool) -> DataFrame:
    """added, removed or kept for each identity; what is missing from an incomplete run is unknown."""
    joined = before.select(key).distinct().withColumn("b", F.lit(True)).join(after.select(key).distinct().withColumn("a", F.lit(True)), key, "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed" if complete else "unknown").otherwise("kept")
    return joined.select(key, change.alias("change"))
