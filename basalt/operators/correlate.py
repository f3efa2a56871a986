"""Templates against observed requests, and operations against a documented list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import urls

VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
PARAMETER = "^(?:\\{[^{}]*\\}|\\$\\{[^{}]*\\}|:[A-Za-z_][A-Za-z0-9_]*)$"


def correlate(templates: DataFrame, observed: DataFrame) -> DataFrame:
    """(finding, url): the most specific template of each observed url, if it is the only one and the finding has one url only.

    templates: finding, method, path; observed: method, url. A template aligns with the whole path of a url,
    or, if its first segment is a parameter standing for a host, with the end of it. The join is on method and
    one constant segment of the template with its distance from the end: of these the one that the fewest
    requests have there, so that common segments make few pairs.
    """
    parts = urls.segments(F.col("path"))
    t = templates.withColumn("parts", parts).withColumn("open", F.coalesce(F.try_element_at(F.col("parts"), F.lit(1)).rlike("^\\$\\{[^{}]*\\}$"), F.lit(False)))
    t = t.withColumn("tail", F.when(F.col("open"), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(F.col("parts")))
    t = t.withColumn("constants", F.filter("tail", lambda s: ~s.rlike(PARAMETER))).where("size(constants) > 0")
    t = t.withColumn("t_size", F.size("tail")).withColumn("verb", F.upper("method"))
    o = observed.distinct().select(F.upper("method").alias("verb"), "url", urls.segments(urls.part(F.col("url"), urls.PATH)).alias("seen"))
    at = o.select("verb", "url", "seen", F.posexplode("seen").alias("k", "segment")).withColumn("back", F.size("seen") - F.col("k")).drop("k")
    common = at.groupBy("verb", "segment", "back").agg(F.count(F.lit(1)).alias("n"))
    key = ["finding", "method", "path"]
    fixed = t.select(*key, "verb", "t_size", F.posexplode("tail").alias("k", "segment")).where(~F.col("segment").rlike(PARAMETER)).withColumn("back", F.col("t_size") - F.col("k"))
    rarest = fixed.join(common, ["verb", "segment", "back"], "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "segment", "back")).alias("x"))
    t = t.join(rarest.where("x.n > 0").select(*key, "x.segment", "x.back"), key)
    pairs = t.join(at, ["verb", "segment", "back"]).where(F.when(F.col("open"), F.size("seen") >= F.col("t_size")).otherwise(F.size("seen") == F.col("t_size")))
    window = F.slice("seen", F.size("seen") - F.size("tail") + 1, F.size("tail"))
    fits = F.forall(F.zip_with("tail", window, lambda a, b: a.rlike(PARAMETER) | (a == b)), lambda x: x)
    score = F.struct(F.size("constants").alias("c"), (-(F.size("seen") - F.size("tail"))).alias("a"))
    scored = pairs.where(fits).select("finding", "url", score.alias("score")).distinct()
    best = scored.groupBy("url").agg(F.max("score").alias("score"))
    top = scored.join(best, ["url", "score"]).select("finding", "url")
    alone = top.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("finding").alias("finding")).where("n = 1")
    return alone.groupBy("finding").agg(F.count_distinct("url").alias("n"), F.min("url").alias("url")).where("n = 1").select("finding", "url")


def compare_path(operation: Column) -> Column:
    """Segments of an operation's path with every parameter, number and uuid as `*`."""
    path = urls.operation_of(F.regexp_replace(operation, "^[^ ]* ", ""))
    wild = lambda s: F.when(s.rlike(PARAMETER) | s.rlike(urls.INTEGER) | s.rlike(urls.UUID), "*").otherwise(s)
    return F.transform(urls.segments(path), wild)


def classify(operations: DataFrame, documented: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """operation, status, reason, matched for each client operation; within: columns of both sides (not null) that name the list an operation is held against.

    documented: ord, operation. In order: other verbs than VERBS are non-http; interpolated ones partial; equal
    method and path documented; one path a proper end of the other suffix-verify; same path under another
    method undocumented-method; else undocumented-path. The end comparison is two equi-joins over exploded
    suffixes instead of a join of all pairs.
    """
    ops = operations.select(*within, "operation").distinct()
    method = F.split_part("operation", F.lit(" "), F.lit(1))
    key = lambda c: F.array_join(c, "/")
    c = ops.withColumn("method", method).withColumn("segs", compare_path(F.col("operation"))).withColumn("path", key(F.col("segs")))
    raw = urls.segments(urls.operation_of(F.regexp_replace(F.col("operation"), "^[^ ]* ", "")))
    mixed = lambda s: s.rlike("[{}$]") & ~s.rlike(PARAMETER)
    partial = F.exists(raw, mixed) | F.coalesce(F.try_element_at(raw, F.lit(1)).rlike("^\\$\\{"), F.lit(False))
    c = c.withColumn("non_http", ~F.col("method").isin(*VERBS)).withColumn("partial", F.coalesce(partial, F.lit(False)))
    d = documented.select(*within, "ord", F.col("operation").alias("doc"), F.split_part("operation", F.lit(" "), F.lit(1)).alias("method"), compare_path(F.col("operation")).alias("segs")).withColumn("path", key(F.col("segs")))
    suffixes = lambda t: t.withColumn("suffix", F.explode(F.when(F.size("segs") > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size("segs"), F.lit(2))), lambda i: F.array_join(F.slice("segs", i, F.size("segs")), "/")))))
    pick = F.min(F.struct("ord", "doc"))["doc"]
    exact = c.join(d, [*within, "method", "path"]).groupBy(*within, "operation").agg(pick.alias("exact"))
    longer = suffixes(d).select(*within, "ord", "doc", "method", F.col("suffix").alias("path")).join(c, [*within, "method", "path"]).select(*within, "operation", "ord", "doc")
    shorter = suffixes(c).select(*within, "operation", "method", F.col("suffix").alias("path")).join(d.where("path <> ''"), [*within, "method", "path"]).select(*within, "operation", "ord", "doc")
    ends = longer.unionByName(shorter).groupBy(*within, "operation").agg(pick.alias("ends"))
    other = c.join(d.select(*within, "ord", "doc", "path"), [*within, "path"]).groupBy(*within, "operation").agg(pick.alias("other"))
    out = c.join(exact, [*within, "operation"], "left").join(ends, [*within, "operation"], "left").join(other, [*within, "operation"], "left")
    reason = F.when(F.col("non_http"), "non-http").when(F.col("partial"), "partial").when(F.col("exact").isNotNull(), "documented").when(F.col("ends").isNotNull(), "suffix-verify")
    reason = reason.when(F.col("other").isNotNull(), "undocumented-method").otherwise("undocumented-path")
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason") == "documented", "documented").when(F.col("reason").isin("undocumented-method", "undocumented-path"), "shadow").otherwise("unresolved")
    matched = F.when(F.col("reason") == "documented", F.col("exact")).when(F.col("reason") == "suffix-verify", F.col("ends")).when(F.col("reason") == "undocumented-method", F.col("other"))
    return out.select(*within, "operation", status.alias("status"), "reason", matched.alias("matched"))


def summary(verdicts: DataFrame) -> DataFrame:
    """Counts of verdicts and the share of suffix matches among what isn't documented."""
    shadow, suffix = F.count_if(F.col("status") == "shadow"), F.count_if(F.col("reason") == "suffix-verify")
    return verdicts.agg(
        F.count_if(F.col("status") == "documented").alias("documented"),
        shadow.alias("shadow"),
        F.count_if(F.col("status") == "unresolved").alias("unresolved"),
        suffix.alias("suffix_verify"),
        F.coalesce(F.try_divide(suffix, shadow + suffix), F.lit(0.0)).alias("ratio"),
    )


def base_url_overlay(operations: DataFrame, rules: DataFrame) -> DataFrame:
    """operation with the base url that applies: of prefix rules the longest, and of equal ones the first in order.

    Each path's segment prefixes are exploded and joined with the rules' prefixes by hash.
    """
    path = urls.segments(urls.operation_of(F.regexp_replace(F.col("operation"), "^[^ ]* ", "")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/")))
    o = operations.select("operation").distinct().withColumn("path_prefix", F.explode(prefixes))
    hit = o.join(rules, "path_prefix").groupBy("operation").agg(F.max(F.struct(F.length("path_prefix").alias("n"), (-F.col("ord")).alias("o"), "base_url"))["base_url"].alias("base_url"))
    return operations.select("operation").distinct().join(hit, "operation", "left")


#: Segments that name their own parameter, and a segment that is one clean `{name}` or `${name}`.
OWN_NAMES = ("{id}", "{uuid}", "{hash}")
SINGLE = "^\\$?\\{([A-Za-z_][A-Za-z0-9_]*)\\}$"


def canonical_path(path: Column) -> Column:
    """The path with every interpolated segment as `{name}`, names made unique by a number; a mixed segment is `{pN}` by position."""
    parts = F.split(path, "/")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("mixed"))

    def step(a: Column, s: Column) -> Column:
        open_ = s.isin(*OWN_NAMES) | s.rlike("[{}$]")
        single = F.regexp_extract(s, SINGLE, 1)
        mixed = a["mixed"] + F.when(open_ & (single == ""), 1).otherwise(0)
        base = F.when(single != "", single).otherwise(F.concat(F.lit("p"), mixed.cast("string")))
        free = F.filter(F.transform(F.sequence(F.lit(1), F.size(a["names"]) + 1), lambda k: F.when(k == 1, base).otherwise(F.concat(base, k.cast("string")))), lambda n: ~F.array_contains(a["names"], n))
        name = F.element_at(free, 1)
        return F.struct(F.concat(a["out"], F.array(F.when(open_, F.concat(F.lit("{"), name, F.lit("}"))).otherwise(s))).alias("out"), F.when(open_, F.concat(a["names"], F.array(name))).otherwise(a["names"]).alias("names"), mixed.alias("mixed"))

    return F.aggregate(parts, start, step, lambda a: F.array_join(a["out"], "/"))
