"""Findings and their places as they are recorded: one row for each, whatever comes again later.

A finding is known in its run by its hash, a place by the hash of eight fields. What a later sighting of a finding
brings is united with what is there: headers of authentication in order of arrival, risk tags as a sorted set, the
kind as long as all that name one agree, other attributes from the first that has one; path, severity and stage
are those of the first sighting. All merges are aggregates with an order, so any cut into batches gives the same
tables, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import identity
from basalt.operators import ranks
from basalt.operators.findings import first_known
from basalt.sources.shared import cut

FINDING = ["run_id", "finding_hash"]
#: What a place is known by.
PLACE = ["raw_url", "host", "source_path", "offset_start", "offset_end", "line", "col", "asset_url"]
CARRIED = ["evidence", "engine", "confidence", "verified"]
FIRST = ["type", "value", "path", "severity", "first_stage"]


def place_hash() -> Column:
    return identity.json_hash(**{c: F.col(c) for c in PLACE})


def _auth(rows: DataFrame) -> DataFrame:
    """Distinct headers of each finding in the order in which they came."""
    each = rows.select(*FINDING, "ord", F.posexplode("auth").alias("k", "a")).groupBy(*FINDING, "a").agg(F.min(F.struct("ord", "k")).alias("at"))
    return each.groupBy(*FINDING).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]).alias("auth"))


def _united(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct("ord", *FIRST)).alias("first")
    agreed = (F.count_if("has_kind") == F.count("kind")) & (F.count_distinct("kind") == 1)
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("risk_tags", F.array().cast("array<string>"))))))
    out = rows.groupBy(*FINDING).agg(first, tags.alias("risk_tags"), F.max("has_kind").alias("has_kind"), F.when(agreed, F.min("kind")).alias("kind"), first_known("wrapper", F.col("ord")).alias("wrapper"))
    out = out.select(*FINDING, *(F.col(f"first.{c}") for c in FIRST), "risk_tags", "has_kind", "kind", "wrapper")
    a, b = out.alias("a"), _auth(rows).alias("b")
    same = (F.col("a.run_id").eqNullSafe(F.col("b.run_id"))) & (F.col("a.finding_hash") == F.col("b.finding_hash"))
    none = F.array().cast(rows.schema["auth"].dataType)
    return a.join(b, same, "left").select("a.*", F.coalesce("b.auth", none).alias("auth"))


def findings(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each run and finding; `known`: what findings() gave for earlier batches, which comes first.

    sightings: run_id, finding_hash, ord, type, value, path, severity, first_stage, auth (array of name, scheme),
    risk_tags, kind, has_kind (whether kind is named at all; named as null counts), wrapper. `ord` is unique in a
    run. kind must be null where has_kind is false.
    """
    columns = [*FINDING, "ord", *FIRST, "auth", "risk_tags", "kind", "has_kind", "wrapper"]
    rows = sightings.select(*columns)
    if known is not None:
        rows = rows.unionByName(known.withColumn("ord", F.lit(None).cast(rows.schema["ord"].dataType)).select(*columns))  # null is before all
    return _united(rows)


def places(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first sighting of each place of a finding: its fields, occurrence_hash and what it carries; of `known` all stay."""
    columns = [*FINDING, *PLACE, *CARRIED]
    key = [*FINDING, "occurrence_hash"]
    rows = sightings.select(*columns, "ord").withColumn("occurrence_hash", place_hash())
    first = rows.groupBy(*key).agg(F.min(F.struct("ord", *PLACE, *CARRIED)).alias("first")).select(*key, *(F.col(f"first.{c}") for c in [*PLACE, *CARRIED]))
    if known is None:
        return first
    n, k = first.alias("n"), known.select(*key).alias("k")
    same = F.col("n.run_id").eqNullSafe(F.col("k.run_id")) & (F.col("n.finding_hash") == F.col("k.finding_hash")) & (F.col("n.occurrence_hash") == F.col("k.occurrence_hash"))
    return known.select(*first.columns).unionByName(n.join(k, same, "left_anti"))


def file_findings(files: DataFrame, seen: DataFrame) -> DataFrame:
    """path and findings: distinct findings at each file that has any.

    files: kind (asset, source, else upload), path, asset_url; seen: finding_hash, source_path, asset_url. An asset
    is met by its own url, a recovered source by path and asset (none is equal to none), an upload by whatever lies
    in `input.js` of no asset. Files of one path count together. Of a path's places only distinct findings are
    joined.
    """
    s = seen.select("finding_hash", "source_path", "asset_url").distinct()
    f = files.select("kind", "path", F.when(F.col("kind") == "source", F.col("asset_url")).alias("asset_url")).distinct()
    assets = f.where("kind = 'asset'").select("path").join(s.select(F.col("asset_url").alias("path"), "finding_hash"), "path")
    a, b = f.where("kind = 'source'").alias("a"), s.alias("b")
    sources = a.join(b, (F.col("a.path") == F.col("b.source_path")) & F.col("a.asset_url").eqNullSafe(F.col("b.asset_url"))).select("a.path", "b.finding_hash")
    # all uploads have the same findings: they are counted once, not joined
    loose = cut(s.where("source_path = 'input.js' AND asset_url IS NULL AND finding_hash IS NOT NULL").select("finding_hash").distinct(), "loose")
    n = loose.count()
    own = assets.unionByName(sources)
    counted = own.groupBy("path").agg(F.count_distinct("finding_hash").alias("findings"))
    if not n:
        return counted
    uploads = f.where("kind NOT IN ('asset', 'source')").select("path").distinct()
    more = own.join(uploads, "path", "left_semi").distinct().join(loose, "finding_hash", "left_anti").groupBy("path").agg(F.count("finding_hash").alias("more"))
    of_uploads = uploads.join(more, "path", "left").select("path", (F.lit(n) + F.coalesce("more", F.lit(0))).alias("findings"))
    return counted.join(uploads, "path", "left_anti").unionByName(of_uploads)


def run_coverage(events: DataFrame) -> DataFrame:
    """One row for each run: counts of all its events, engine, source map of the newest event and the number of files.

    events: run_id, id, attributed, unattributed, secrets, secrets_engine, sources_recovered, source_map, files
    (array of path, attributed, unattributed). One event without an engine makes the run's `unavailable`.
    """
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    engine = F.when(F.coalesce(F.max(F.col("secrets_engine") == "unavailable"), F.lit(False)), "unavailable").otherwise("ok")
    newest = F.coalesce(F.max_by("source_map", "id"), F.lit("none"))
    return events.groupBy("run_id").agg(total("attributed"), total("unattributed"), total("secrets"), engine.alias("secrets_engine"), total("sources_recovered"), newest.alias("source_map"), F.sum(F.coalesce(F.size("files"), F.lit(0))).alias("files"))


def run_files(events: DataFrame) -> DataFrame:
    """run_id, place, path, attributed, unattributed: the files of all events, newest event first, as they stand in it; equal paths stay apart."""
    each = events.select("run_id", "id", F.posexplode("files").alias("k", "f"))
    sizes = events.groupBy("run_id", "id").agg(F.sum(F.coalesce(F.size("files"), F.lit(0))).alias("n")).withColumn("back", -F.col("id"))
    starts = ranks.ranked(sizes, ["run_id"], ["back"], {"end": "n"}).select(F.col("run_id").alias("_run"), F.col("id").alias("_id"), (F.col("end") - F.col("n")).alias("start"))
    joined = each.join(starts, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("id") == F.col("_id")))
    return joined.select("run_id", (F.col("start") + F.col("k") + 1).alias("place"), F.coalesce("f.path", F.lit("")).alias("path"), F.coalesce("f.attributed", F.lit(0)).alias("attributed"), F.coalesce("f.unattributed", F.lit(0)).alias("unattributed"))
