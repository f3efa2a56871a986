"""The findings of runs as a reader sees them: verdicts laid over, sightings in other runs, secrets kept back, in order.

Two tables come out, one row for each finding and one for each occurrence, both with their place in the order of
their run or finding. Nothing is nested that grows with the number of sightings; a finding carries counts and its
distinct hosts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators import findings as merge
from basalt.operators import ranks

SECRET = "secret"
#: What stands for a verdict that nobody has given.
UNCLASSIFIED, UNTRIAGED = "unclassified", "untriaged"
ORIGINS = ["capture", "platform"]


def _with(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key is a key like others."""
    b = b.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    return a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*(f"_{k}" for k in keys))


def occurrence_view(findings: DataFrame, occurrences: DataFrame, runs: DataFrame, assets: DataFrame) -> DataFrame:
    """run, finding_hash, place (within the finding), host, source_path, offset_start, offset_end, evidence, asset_url, readable.

    A secret's evidence is kept back. readable: the blob that the offsets point into is known, the asset's if the
    occurrence has one, else the run's.
    """
    types = findings.select("run", "finding_hash", "type")
    own = _with(occurrences, types, ["run", "finding_hash"]).where("type IS NOT NULL")
    own = _with(own, assets.select("run", "asset", F.col("url").alias("asset_url"), F.col("input_ref").alias("asset_ref")), ["run", "asset"])
    own = _with(own, runs.select("run", F.col("input_ref").alias("run_ref")), ["run"])
    ref = F.when(F.col("asset").isNotNull(), F.col("asset_ref")).otherwise(F.col("run_ref"))
    own = own.withColumns({"_path": F.coalesce("source_path", F.lit("")), "_start": F.coalesce("offset_start", F.lit(0)), "readable": ref.isNotNull() & F.col("offset_start").isNotNull() & F.col("offset_end").isNotNull()})
    placed = ranks.ranked(own, ["run", "finding_hash"], ["_path", "_start", "occurrence_hash"])
    evidence = F.when(F.col("type") != SECRET, F.col("evidence"))
    return placed.select("run", "finding_hash", "place", "type", "host", "source_path", "offset_start", "offset_end", evidence.alias("evidence"), "asset_url", "readable")


def findings_view(findings: DataFrame, seen: DataFrame, triage: DataFrame, verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each finding, with its place in its run by type, value and hash.

    seen: of occurrence_view(). triage: session, finding_hash, status. verdicts: session, finding_hash, status,
    reason, matched. runs: run, session, engagement, origin (capture or platform). sightings_*: other runs of the
    engagement that have the finding; null for a run without one. revealable: a secret that can be read somewhere.
    """
    owner = runs.select("run", "session", "engagement", "origin")
    out = _with(findings.select("run", "finding_hash", "type", "value", "path"), owner, ["run"])
    grouped = out.where("engagement IS NOT NULL").select("run", "engagement", "finding_hash", "origin")
    others = merge.sightings(grouped, "run", "engagement", "finding_hash", "origin", ORIGINS)
    others = others.select("run", "finding_hash", *(F.col(f"from_{o}").cast("long").alias(f"sightings_{o}") for o in ORIGINS))
    # one row for each host of a finding before hosts are listed
    by_host = seen.groupBy("run", "finding_hash", "host").agg(F.count(F.lit(1)).alias("n"), F.max("readable").alias("readable"))
    counts = by_host.groupBy("run", "finding_hash").agg(F.sum("n").alias("occurrences"), F.max("readable").alias("readable"), F.array_sort(F.collect_set(F.when(F.col("host") != "", F.col("host")))).alias("hosts"))
    out = _with(out, counts, ["run", "finding_hash"])
    out = _with(out, triage.select("session", "finding_hash", F.col("status").alias("triage")), ["session", "finding_hash"])
    out = _with(out, verdicts.select("session", "finding_hash", F.col("status").alias("class"), "reason", "matched"), ["session", "finding_hash"])
    out = _with(out, others, ["run", "finding_hash"])
    revealable = (F.col("type") == SECRET) & F.coalesce("readable", F.lit(False))
    rows = out.select("run", "session", "finding_hash", "type", "value", "path", "triage", "class", "reason", "matched", *(f"sightings_{o}" for o in ORIGINS), revealable.alias("revealable"), F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"), F.coalesce("hosts", F.array().cast("array<string>")).alias("hosts"))
    return ranks.ranked(rows, ["run"], ["type", "value", "finding_hash"])


def facet_values(view: DataFrame) -> dict[str, Column]:
    """The values of each facet of a finding, as an array."""
    return {"type": F.array("type"), "class": F.array(F.coalesce("class", F.lit(UNCLASSIFIED))), "triage": F.array(F.coalesce("triage", F.lit(UNTRIAGED))), "host": F.col("hosts")}


def visible(view: DataFrame, chosen: dict[str, list[str]], text: str = "") -> DataFrame:
    """Findings that have one of the chosen values in each facet for which any are chosen, and the text in value, path, matched operation or a host."""
    out = view
    for name, values in facet_values(view).items():
        if chosen.get(name):
            out = out.where(F.arrays_overlap(values, F.array(*map(F.lit, chosen[name]))))
    if text:
        parts = F.concat_ws(" ", "value", "path", "matched", F.array_join("hosts", " "))
        out = out.where(F.contains(F.lower(parts), F.lit(text.lower())))
    return out


def facet_counts(view: DataFrame) -> DataFrame:
    """facet, value, n over the findings of a view."""

    def pairs_of(name: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(name).alias("facet"), x.alias("value")))

    pairs = F.concat(*(pairs_of(name, values) for name, values in facet_values(view).items()))
    return view.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))
