"""Endpoint findings of whole sessions against the operations that their descriptions list, kept as one table.

A finding is looked at once for each session, whatever number of its runs has it. Its operation is first brought
to the path it has behind its base:

1. seen by capture in the session: a leading `${name}` goes, as what was captured proves the base;
2. seen with a host anywhere in the session (any finding of the operation): as it is;
3. else the newest selection that names the finding, or the prefix rule of the most segments, puts its base's
   path in front, unless the path is under it already.

Then it is classified against the session's list, and the verdicts replace those of earlier times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import urls
from basalt.operators import correlate
from basalt.sources.shared import cut

KEY = ["session", "finding_hash"]
VERDICT = ["status", "reason", "matched", "spec_ref"]
LEADING = "^\\$\\{[^}]*\\}$"


def path_of(operation: Column) -> Column:
    """What follows the method; `/` where nothing does."""
    path = F.regexp_extract(operation, "^[^ ]* (.*)$", 1)
    return F.when(path == "", "/").otherwise(path)


def without_base_variable(path: Column) -> Column:
    """The path without a first segment that is one `${name}`; parameters further on stay."""
    parts = urls.segments(path)
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).rlike(LEADING)
    return F.concat(F.lit("/"), F.array_join(F.when(first, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts), "/"))


def base_of(base_url: Column) -> Column:
    """struct(scheme, host, path) of a rule's base; scheme and host are null for a base that is a path alone."""
    whole = base_url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//")
    part = lambda k: F.when(whole, urls.part(base_url, k))
    path = F.when(whole, urls.part(base_url, urls.PATH)).otherwise(base_url)
    return F.struct(F.lower(F.regexp_extract(F.when(whole, base_url), "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), part(urls.AUTHORITY).alias("host"), F.regexp_replace(path, "/+$", "").alias("path"))


def findings_of(sightings: DataFrame) -> DataFrame:
    """One row for each session and finding: operation, whether the operation was seen with a host, whether capture saw the finding.

    sightings: session, finding_hash, operation, host, engine; one row for each place of each run.
    """
    each = sightings.groupBy(*KEY, "operation").agg(F.max(F.col("host").isNotNull()).alias("hosted"), F.coalesce(F.max(F.col("engine") == "capture"), F.lit(False)).alias("captured"))
    hosted = each.where("hosted").select("session", "operation").distinct().withColumn("absolute", F.lit(True))
    out = each.drop("hosted").join(hosted, ["session", "operation"], "left")
    return out.withColumn("absolute", F.coalesce("absolute", F.lit(False)))


def rebased(findings: DataFrame, selections: DataFrame, prefixes: DataFrame) -> DataFrame:
    """findings with base_url (of the rule that applies, else null), base_host, and path as it is classified.

    findings: of findings_of(). selections: session, finding_hash, base_url, recency; prefixes: session,
    path_prefix, base_url, recency (the larger the newer). Prefixes meet paths by hash: a path is exploded to its
    own leading segments, of which it has few. findings is read four times, so it should be a table.
    """
    f = findings.withColumn("own", path_of(F.col("operation")))
    open_ = f.where(~F.col("captured") & ~F.col("absolute") & F.startswith("own", F.lit("/")))
    newest = F.max(F.struct("recency", "base_url"))["base_url"]
    chosen = selections.where("base_url IS NOT NULL").groupBy(*KEY).agg(newest.alias("selected"))
    of_prefix = prefixes.where("path_prefix <> '' AND base_url IS NOT NULL").withColumn("lead", F.array_join(urls.segments(F.col("path_prefix")), "/"))
    of_prefix = of_prefix.groupBy("session", "lead").agg(newest.alias("base_url"))
    parts = urls.segments(F.col("own"))
    leads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("lead")))
    own = open_.select("session", "own").distinct().select("session", "own", F.explode(leads).alias("x")).select("session", "own", "x.n", "x.lead")
    longest = own.join(of_prefix, ["session", "lead"]).groupBy("session", "own").agg(F.max_by("base_url", "n").alias("by_prefix"))
    rules = open_.select(*KEY, "operation", "own").join(chosen, KEY, "left").join(longest, ["session", "own"], "left")
    rules = rules.select(*KEY, "operation", F.coalesce("selected", "by_prefix").alias("base_url")).where("base_url IS NOT NULL")
    out = f.join(rules, [*KEY, "operation"], "left").withColumn("base", base_of(F.col("base_url")))
    base = urls.segments(F.col("base.path"))
    under = F.slice(parts, F.lit(1), F.size(base)) == base
    path = F.when(F.col("captured"), without_base_variable(F.col("own"))).when((F.col("base.path") != "") & ~under, F.concat("base.path", "own")).otherwise(F.col("own"))
    return out.select(*KEY, "operation", "captured", "absolute", "base_url", F.col("base.host").alias("base_host"), path.alias("path"))


def verdicts(sightings: DataFrame, selections: DataFrame, prefixes: DataFrame, documented: DataFrame) -> DataFrame:
    """session, finding_hash, status, reason, matched, spec_ref of every finding of a session that has a description.

    documented: session, spec_ref, ord, operation; operation null: a description without operations. Findings of
    other sessions get no row.
    """
    specs = documented.groupBy("session").agg(F.max("spec_ref").alias("spec_ref"))
    # each is read several times below: written once, the plans stay small and no stage runs twice
    own = cut(findings_of(sightings.join(specs.select("session"), "session", "left_semi")), "findings")
    at = rebased(own, selections, prefixes).withColumn("resolved", F.concat_ws(" ", F.split_part("operation", F.lit(" "), F.lit(1)), "path"))
    at = cut(at.select(*KEY, "resolved"), "rebased")
    known = documented.where("operation IS NOT NULL").select("session", "ord", "operation")
    found = correlate.classify(at.select("session", F.col("resolved").alias("operation")), known, ("session",)).withColumnRenamed("operation", "resolved")
    return at.join(found, ["session", "resolved"]).join(specs, "session").select(*KEY, *VERDICT)


def upserted(current: DataFrame, new: DataFrame) -> DataFrame:
    """current with the new verdicts in place of the old ones of their keys; `changed`: whether a row differs from what it was.

    Rows of current that have no new verdict stay. Applying the same verdicts again changes nothing.
    """
    c, n = current.select(*KEY, *VERDICT).alias("c"), new.alias("n")
    same_key = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY])
    use = F.col("n.status").isNotNull()
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in VERDICT])
    pick = [F.when(use, F.col(f"n.{k}")).otherwise(F.col(f"c.{k}")).alias(k) for k in [*KEY, *VERDICT]]
    return c.join(n, same_key, "full").select(*pick, (use & ~same).alias("changed"))
