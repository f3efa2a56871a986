"""Queries over the read side: joins of sightings, orders, requests, tallies, rules and control events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import labels, urls
from basalt.operators import correlate, fingerprints, intervals, ranks
from basalt.operators.findings import percent
from basalt.plans import sql
from basalt.plans.labels import dealt, pick
from basalt.sources.views import endpoints, links, table

KINDS = ["endpoint", "endpoint_generic", "page_route", "secret"]
#: tech, surface, key, value of the rules that the queries try.
TECH_RULES = [("html5", "markup", "", "(?i)<!doctype html>"), ("tracker", "markup", "", "track\\(([0-9])([0-9]*)\\)\\;version:v\\1?\\1.x:none\\;confidence:40"), ("ads", "markup", "", "class=\"ad\"\\;confidence:ten"), ("numbered", "markup", "", "track\\(([0-9])\\)\\;version:\\1\\;confidence:30"), ("link", "script_src", "", "href")]


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Links as sightings: finding (by href), run, page, ordinal, kind."""
    return links(spark, sf).select("page_id", "run_id", "url", F.col("ordinal").cast("long").alias("ordinal"), "href", pick(KINDS, F.length("href")).alias("kind"))


def b03_not_archived(spark: SparkSession, sf: str) -> DataFrame:
    archived = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_custkey", archived.alias("archived_at")).where("archived_at IS NULL").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def b07_scope_list(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.array(F.lit(" A.example. "), F.concat("event_type", F.lit(".example")), F.lit("*.a.example"), F.lit("no_label"), F.lit(""))
    names = F.transform(raw, lambda h: F.regexp_replace(F.lower(F.rtrim(F.trim(h), F.lit("."))), "^\\*\\.", ""))
    good = F.array_distinct(F.filter(names, lambda h: h.rlike("^[a-z0-9-]+(\\.[a-z0-9-]+)+$")))
    return table(spark, sf, "events").select("event_id", F.array_join(good, ",").alias("scope"))


def b12_redacted(spark: SparkSession, sf: str) -> DataFrame:
    evidence = F.when(F.col("kind") != "secret", F.col("href"))
    return _sightings(spark, sf).select("page_id", "ordinal", "kind", evidence.alias("evidence"))


def b13_facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    hosts = endpoints(spark, sf, hashed=False).groupBy("operation").agg(F.collect_set("host").alias("hosts"), F.min("run_id").alias("run_id"))
    return hosts.where(F.arrays_overlap("hosts", F.array(F.lit("example.com"), F.lit("example.org"))) & F.col("run_id").isin(0, 1, 2, 3)).select("operation", F.col("run_id").cast("long").alias("run_id"))


def b15_hosts_sorted(spark: SparkSession, sf: str) -> DataFrame:
    h = endpoints(spark, sf).where(F.contains("host", F.lit("e"))).groupBy("host").agg(F.count_distinct("finding_hash").alias("n"))
    return h.orderBy(F.desc("n"), "host")


def b23_size_limits(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("source", "doc_id", F.octet_length("text").cast("long").alias("size")).where("size <= 10000")
    return ranks.within_limits(docs, ["source"], ["doc_id"], "size", 50_000, 40).select("source", "doc_id", "total")


def b26_transitions(spark: SparkSession, sf: str) -> DataFrame:
    chain = dict(zip(("queued", *labels.STAGES[:-1]), ([s] for s in labels.STAGES), strict=True)) | {"correlating": ["done", "partial"]}
    edges = {(a, b) for a, bs in chain.items() for b in bs}
    edges |= {(s, b) for s in labels.STAGES for b in ("paused", "failed", "cancelled", "partial")} | {("queued", "paused"), ("queued", "cancelled")}
    edges |= {("paused", s) for s in (*labels.STAGES, "cancelled", "failed")}
    allowed = spark.createDataFrame(sorted(edges), "a string, b string")
    states = ["queued", *labels.STAGES, "paused", *labels.TERMINAL]
    steps = table(spark, sf, "events").select("event_id", pick(states, F.col("event_id")).alias("a"), pick(states, F.col("user_id")).alias("b"))
    return steps.join(F.broadcast(allowed.withColumn("legal", F.lit(True))), ["a", "b"], "left").groupBy("a", "b").agg(F.coalesce(F.max("legal"), F.lit(False)).alias("legal"), F.count(F.lit(1)).alias("n"))


def c01_lane_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = _sightings(spark, sf).withColumn("host", urls.host(F.col("url")))
    return s.groupBy("host").agg(*(F.count_distinct(F.when(F.col("kind") == k, F.col("href"))).alias(f"n_{k}") for k in KINDS))


def c04_asset_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "source")
    return _sightings(spark, sf).select("page_id", "ordinal").join(docs, "page_id", "left")


def c05_session_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return endpoints(spark, sf).select(F.pmod("run_id", F.lit(3)).cast("long").alias("session"), "finding_hash", "value").distinct()


def c07_capture_resolved(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    proven = ep.where("run_id = 5").select("finding_hash")
    return ep.join(proven, "finding_hash", "left_semi").select("finding_hash", "operation").distinct()


def c08_latest_with_job(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    runs = table(spark, sf, "orders").join(jobs, "o_orderkey", "left_semi")
    return runs.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


def c09_operation_params(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    params = ep.where(F.contains("value", F.lit("?"))).select("operation", F.explode(F.split(F.split_part("value", F.lit("?"), F.lit(2)), "&")).alias("name")).groupBy("operation").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("params"))
    return ep.groupBy("operation").agg(F.count_distinct("finding_hash").alias("findings")).join(params, "operation", "left")


def c15_first_classified(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    verdict = F.when(F.pmod("page_id", F.lit(3)) > 0, F.concat(F.lit("v"), F.pmod("page_id", F.lit(3)).cast("string")))
    one = ep.groupBy("operation", "finding_hash").agg(F.min(F.when(verdict.isNotNull(), F.struct("page_id", verdict.alias("v"))))["v"].alias("verdict"), F.min("url").alias("trace"))
    return one.groupBy("operation").agg(F.min(F.when(F.col("verdict").isNotNull(), F.struct("finding_hash", "verdict")))["verdict"].alias("verdict"), F.min(F.struct("finding_hash", "trace"))["trace"].alias("trace"))


def c16_file_findings(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.pmod("event_id", F.lit(4)) == 0, "input.js").when(F.pmod("event_id", F.lit(4)) == 1, "src/a.js")
    asset = F.when(F.pmod("event_id", F.lit(6)) > 1, F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")))
    seen = table(spark, sf, "events").select(path.alias("path"), asset.alias("asset"), "event_type")
    files = seen.select("path", "asset").distinct().where("path IS NOT NULL")
    return files.alias("f").join(seen.alias("s"), F.col("f.path").eqNullSafe(F.col("s.path")) & F.col("f.asset").eqNullSafe(F.col("s.asset"))).groupBy("f.path", "f.asset").agg(F.count_distinct("s.event_type").alias("findings"))


def c17_recovered_sources(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.pmod("event_id", F.lit(4)) == 0, "input.js").when(F.pmod("event_id", F.lit(4)) < 3, F.concat(F.lit("src/"), "event_type"))
    return table(spark, sf, "events").select(path.alias("path"), F.pmod("user_id", F.lit(7)).cast("long").alias("asset")).where("path IS NOT NULL AND path <> 'input.js'").distinct()


def d03_file_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("src/"), F.pmod("user_id", F.lit(9)).cast("string")).alias("path"), F.col("event_type").isin("error", "view").alias("u"))
    return e.groupBy("path").agg(F.count_if(~F.col("u")).alias("attributed"), F.count_if("u").alias("unattributed")).orderBy("path")


def d06_last_asset(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").where("url IS NOT NULL").select(F.pmod("page_id", F.lit(8)).cast("long").alias("run_id"), "url", "page_id", F.octet_length("html").cast("long").alias("n"), F.contains("html", F.lit("<nav>")).alias("source_map"))
    return p.groupBy("run_id").agg(F.sum("n").alias("attributed"), F.max(F.struct("url", "page_id", "source_map"))["source_map"].alias("source_map"))


def d10_percent_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderpriority") != "1-URGENT").alias("total"))
    return o.select("o_custkey", F.coalesce(percent(F.least("done", "total"), F.col("total")), F.lit(0)).alias("percent"))


def d13_technologies(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.pmod("user_id", F.lit(11)).cast("long").alias("host"), "event_type").agg(F.least(F.count(F.lit(1)), F.lit(100)).alias("confidence"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "event_type")))
    return e.groupBy("host").agg(listed.alias("x")).select("host", F.array_join(F.transform("x", lambda t: F.concat(t["event_type"], F.lit(":"), (-t["c"]).cast("string"))), ",").alias("technologies"))


def d15_run_scoped(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    verdicts = ep.groupBy("finding_hash").agg(F.count_distinct("run_id").alias("runs")).where("runs < 6").select("finding_hash", F.when(F.col("runs") > 2, "documented").otherwise("shadow").alias("status"))
    return ep.select("run_id", "finding_hash").distinct().join(verdicts, "finding_hash").groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count_if(F.col("status") == "documented").alias("documented"), F.count_if(F.col("status") == "shadow").alias("shadow"))


def d17_request_merge(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf, hashed=False).withColumn("path", F.regexp_replace("operation", "^GET /(fr|de)/", "GET /any/"))
    one = ep.groupBy("operation", "path").agg(F.collect_set("host").alias("hosts"), F.min("url").alias("example"), F.max(F.when(F.contains("value", F.lit("?")), F.lit("query"))).alias("content"))
    return one.groupBy("path").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hosts")))), ",").alias("hosts"), F.min("example").alias("example"), F.min(F.when(F.col("content").isNotNull(), F.struct("operation", "content")))["content"].alias("content"))


def d18_example_url(spark: SparkSession, sf: str) -> DataFrame:
    return endpoints(spark, sf).groupBy("operation").agg(F.min(F.struct((F.col("run_id") != 3).alias("late"), "finding_hash", "page_id", "url"))["url"].alias("example_url"))


def d19_operation_union(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    found = c.select("role", F.explode(F.regexp_extract_all("text", F.lit("\\b(what|how|why|the) ([a-z]+)"), F.lit(0))).alias("op"))
    return found.select(F.split_part("op", F.lit(" "), F.lit(1)).alias("kind"), F.split_part("op", F.lit(" "), F.lit(2)).alias("name"), "role").distinct().orderBy("kind", "name", "role")


def d21_overview(spark: SparkSession, sf: str) -> DataFrame:
    ep = endpoints(spark, sf)
    return ep.agg(F.count_distinct("page_id").alias("files"), F.count_distinct("finding_hash").alias("endpoints"), F.count_distinct(F.when(F.col("host").endswith(".com"), F.col("host"))).alias("inside"), F.count_distinct(F.when(~F.col("host").endswith(".com"), F.col("host"))).alias("outside"), F.coalesce(percent(F.count("host"), F.count(F.lit(1))), F.lit(0)).alias("attributed"))


def d23_source_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("text").isNull() | (F.col("text") == ""), "missing").when(F.col("lang").isin("en", "fr"), "fetched").when(F.col("lang") == "de", "uploaded").otherwise("recovered")
    return table(spark, sf, "documents").agg(*(F.count_if(kind == k).alias(k) for k in ("fetched", "missing", "uploaded", "recovered")))


def d25_progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when((F.col("event_type") == "error") | (F.pmod("user_id", F.lit(4)) == 0) & (F.col("event_type") != "purchase"), "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "analyzing").otherwise("queued")
    return table(spark, sf, "events").groupBy("user_id").agg(*(F.count_if(status == s).alias(s) for s in ("queued", "analyzing", "completed", "failed")))


def d26_final_state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.bool_and(F.when(F.col("event_type") == "signup", F.col("value") > 20)).alias("crawl"),
        F.bool_and(F.when(F.col("event_type") == "view", F.col("value") > 2)).alias("fetch"),
        F.bool_and(F.when(F.col("event_type") == "click", F.col("value") > 2)).alias("analyze"),
    )
    whole = F.coalesce("crawl", F.lit(True)) & F.coalesce("fetch", F.lit(True)) & F.coalesce("analyze", F.lit(True))
    return e.select("user_id", F.when(whole, "done").otherwise("partial").alias("state"))


def d27_target_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def d30_fetch_summary(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.trim(F.concat(F.lit(" "), F.pmod("event_id", F.lit(5)).cast("string"), F.lit(" ")))
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", reason).alias("reason"))
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type").isin("view", "click")).alias("ok"), F.count("reason").alias("failed"))
    top = e.where("reason IS NOT NULL").groupBy("user_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).groupBy("user_id").agg(F.max(F.struct("n", -F.col("first"), "reason"))["reason"].alias("top_reason"))
    return counts.withColumn("pending", F.col("total") - F.col("ok") - F.col("failed")).join(top, "user_id", "left")


def d31_line_marks(spark: SparkSession, sf: str) -> DataFrame:
    line = F.floor(F.col("ordinal") / 3).alias("line")
    return _sightings(spark, sf).groupBy("page_id", line).agg(F.min(F.struct("ordinal", "kind"))["kind"].alias("mark"))


def e01_findings_order(spark: SparkSession, sf: str) -> DataFrame:
    f = endpoints(spark, sf).select("finding_hash", "value", F.when(F.contains("value", F.lit("?")), "param").otherwise("endpoint").alias("type")).distinct()
    return ranks.ranked(f, ["type"], ["value", "finding_hash"]).select("type", "value", "finding_hash", "place").orderBy("type", "value", "finding_hash")


def e02_occurrence_order(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.pmod("ordinal", F.lit(3)) > 0, F.col("kind"))
    start = F.when(F.pmod("ordinal", F.lit(2)) > 0, F.col("ordinal"))
    rows = _sightings(spark, sf).select("page_id", F.struct(F.coalesce(path, F.lit("")).alias("p"), F.coalesce(start, F.lit(0)).alias("s"), "href", "ordinal").alias("o"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["ordinal"].cast("string")), ",").alias("ordinals"))


def e04_latest_job(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.latest(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber"], ["l_returnflag"])


def e05_latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("props"))


def e06_bounded_prefix(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").where("url IS NOT NULL").select(F.pmod("page_id", F.lit(8)).cast("long").alias("run_id"), "url", "page_id")
    ranked = p.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("url", "page_id"))).where("k <= 16")
    host = urls.host(F.col("url"))
    return ranked.groupBy("run_id").agg(F.min(F.when(host.endswith(".org"), F.struct("k", host.alias("h"))))["h"].alias("host"))


def e09_recent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


def e10_rule_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) - 1).cast("long").alias("ordinal"))


def e13_next_line(spark: SparkSession, sf: str) -> DataFrame:
    s = _sightings(spark, sf).select("page_id", F.floor(F.col("ordinal") / 2).alias("line")).distinct()
    per_page = s.groupBy("page_id").agg(F.min("line").alias("first"))
    nxt = F.lead("line").over(Window.partitionBy("page_id").orderBy("line"))
    return s.withColumn("next", nxt).join(per_page, "page_id").select("page_id", "line", F.coalesce("next", "first").alias("next"))


def e14_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    ended, started = F.when(F.col("event_type") == "purchase", F.col("value") * 3), F.when(F.col("event_type").isin("purchase", "view"), F.col("value") * 2)
    return table(spark, sf, "events").select("event_id", F.coalesce(ended, started, "value").alias("shown"))


def f03_unclaimed(spark: SparkSession, sf: str) -> DataFrame:
    s = _sightings(spark, sf).select("page_id", "ordinal", (F.col("ordinal") + F.pmod(F.length("href"), F.lit(4))).alias("until"))
    reach = F.max("until").over(Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("reach", reach).where("reach IS NULL OR until > reach").select("page_id", "ordinal")


def f04_scope_equal(spark: SparkSession, sf: str) -> DataFrame:
    def canonical(*hosts: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.array(*hosts), lambda h: F.regexp_replace(F.lower(h), "^\\*\\.", ""))))

    a = canonical(F.concat(F.lit("*."), F.col("event_type")), F.lit("B.example"), F.lit("b.example"))
    b = canonical(F.lit("b.example"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("click")).otherwise(F.upper("event_type")))
    return table(spark, sf, "events").select("event_id", (a == b).alias("same"))


def f05_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "href"))), lambda x: x["href"])
    return _sightings(spark, sf).groupBy("page_id").agg(F.array_join(F.array_distinct(listed), " ").alias("hrefs"))


def k10_base_stripped(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("/${base}"), urls.part(F.col("url"), urls.PATH), F.lit("/${slug}"))).otherwise(urls.part(F.col("url"), urls.PATH))
    parts = urls.segments(path)
    kept = F.when(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).rlike("^\\$\\{[^}]*\\}$"), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", F.concat(F.lit("/"), F.array_join(kept, "/")).alias("path"))


def k14_probe_host(spark: SparkSession, sf: str) -> DataFrame:
    r = endpoints(spark, sf, hashed=False).groupBy("operation").agg(F.array_sort(F.collect_set(F.when(F.col("run_id") > 5, F.col("host")))).alias("hosts"))
    filled = F.when((F.size("hosts") == 0) & F.col("operation").rlike("^GET /"), F.array(F.lit("probe.example"))).otherwise(F.col("hosts"))
    return r.select("operation", F.array_join(filled, ",").alias("hosts"))


def k15_canonical_path(spark: SparkSession, sf: str) -> DataFrame:
    extra = ["", "/${a}/x${b}", "/{id}", "/${slug}/{slug}", "/$x"]
    path = F.concat(urls.template_path(urls.part(F.col("url"), urls.PATH)), pick(extra, F.col("page_id")))
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", correlate.canonical_path(path).alias("path"))


def k17_security(spark: SparkSession, sf: str) -> DataFrame:
    header, scheme = pick(["Authorization", "X-Api-Key", "authorization"], F.col("event_id")), pick(["Bearer", "Basic", "", "Custom"], F.col("user_id"))
    known = (F.lower(header) == "authorization") & F.lower(scheme).isin("bearer", "basic")
    return table(spark, sf, "events").select(F.when(known, F.concat(F.lit("http:"), F.lower(scheme))).otherwise(F.concat(F.lit("apiKey:"), header)).alias("scheme")).groupBy("scheme").agg(F.count(F.lit(1)).alias("n"))


def l02_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")).select("user_id", "x.event_id", "x.event_type", "x.value")


def l05_cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")
    return table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def l06_rename(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")).alias("new"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(names, "c_custkey", "left").select("c_custkey", F.coalesce("new", "c_name").alias("name"))


def l07_clone_decision(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    target, scope = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("b.example")), F.when(F.pmod("event_id", F.lit(4)) == 0, F.array(F.lit("A.example"), F.lit("b.example")))
    old = F.array(F.lit("a.example"))
    new_scope = F.coalesce(scope, old)
    same = F.array_sort(F.array_distinct(F.transform(new_scope, F.lower))) == F.array_sort(old)
    inside = F.exists(new_scope, lambda s: F.lower(s) == F.coalesce(target, F.lit("a.example")))
    return e.select("event_id", F.coalesce(target, F.lit("a.example")).alias("target"), (~same | ~inside).alias("fork"))


def l08_rule_deleted(spark: SparkSession, sf: str) -> DataFrame:
    ops = endpoints(spark, sf, hashed=False).select("operation").distinct()
    rules = spark.createDataFrame([(0, "/fr", True), (1, "/de", False), (2, "/", False)], "ord int, prefix string, deleted boolean").where("NOT deleted")
    path = F.regexp_replace("operation", "^[A-Z]+ ", "")
    fits = ops.join(F.broadcast(rules), F.startswith(path, F.col("prefix")), "left")
    return fits.groupBy("operation").agg(F.min(F.struct("ord", "prefix"))["prefix"].alias("prefix"))


def l09_control(spark: SparkSession, sf: str) -> DataFrame:
    state, wish = pick(["queued", "analyzing", "paused", "done", "failed"], F.col("event_id")), pick(["pause", "cancel", "resume"], F.col("user_id"))
    ended = state.isin(*labels.TERMINAL)
    out = F.when(ended & (wish == "cancel"), "kept").when(ended, "error").when(wish == "pause", F.when(state == "queued", "paused").when(state == "paused", "kept").otherwise("requested"))
    out = out.when(wish == "cancel", F.when(state.isin("queued", "paused"), "cancelled").otherwise("requested")).when(state == "paused", "resumed").otherwise("error")
    return table(spark, sf, "events").groupBy(state.alias("state"), wish.alias("wish"), out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def m07_absolute_max(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("value").alias("total"), F.max(F.struct("value", "event_id", "event_type"))["event_type"].alias("last_host"))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    return pages.select(urls.host(F.col("url")).alias("host"), F.lit("markup").alias("surface"), F.lit("").alias("key"), F.col("html").alias("value"), F.col("page_id").alias("ord"))


def _rules(spark: SparkSession) -> DataFrame:
    return fingerprints.parsed_rules(spark.createDataFrame(TECH_RULES, "tech string, surface string, key string, value string"))


def j02_field_values(spark: SparkSession, sf: str) -> DataFrame:
    values = ["a\\;version:\\1", "b\\;confidence:50\\;version:x", "c", "d\\;confidence:high", "e\\;version:1\\;version:2"]
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("tech"), F.lit("header").alias("surface"), F.lit("k").alias("key"), pick(values, F.col("event_id")).alias("value"))
    return fingerprints.parsed_rules(rows).select(F.col("tech").cast("long").alias("event_id"), "pattern", "version", F.col("confidence").cast("long").alias("confidence"))


def j03_versions(spark: SparkSession, sf: str) -> DataFrame:
    templates = ["v\\1.\\2", "\\3?yes:no", "x\\2?has \\2:none", "", "\\9", " \\1 "]
    groups = F.array(F.col("event_type"), F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit("\\1")).otherwise(F.lit("")), F.lit(""))
    return table(spark, sf, "events").select("event_id", fingerprints.resolved_version(pick(templates, F.col("event_id")), groups).alias("version"))


def j09_categories(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for item in {1: "CMS", 6: "Ecommerce", 10: "Analytics"}.items() for x in item))
    ids = F.array(F.pmod("event_id", F.lit(12)).cast("int"), F.lit(6), F.lit(99))
    known = F.filter(F.transform(ids, lambda k: F.try_element_at(names, k)), lambda n: n.isNotNull())
    return table(spark, sf, "events").select("event_id", F.array_join(known, ",").alias("categories"))


def j01_detect(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.detections(_signals(spark, sf), _rules(spark)).select("host", "tech", "confidence", "version")


E, L = sql.ENDPOINTS, sql.LINKS
S = f"{L}, s AS (SELECT page_id, run_id, url, ordinal, href, {dealt(KINDS, 'length(href)')} AS kind FROM links)"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_STATES = ["queued", *labels.STAGES, "paused", *labels.TERMINAL]
_ACTIVE = str(tuple(labels.STAGES))
_LEGAL = f"(a, b) IN (('queued', 'discovering'), ('discovering', 'fetching'), ('fetching', 'ingesting'), ('ingesting', 'analyzing'), ('analyzing', 'correlating'), ('correlating', 'done'), ('queued', 'paused'), ('queued', 'cancelled'), ('paused', 'cancelled'), ('paused', 'failed')) OR a IN {_ACTIVE} AND b IN ('paused', 'failed', 'cancelled', 'partial') OR a = 'paused' AND b IN {_ACTIVE}"
_VALUES = ["a\\;version:\\1", "b\\;confidence:50\\;version:x", "c", "d\\;confidence:high", "e\\;version:1\\;version:2"]
_TECH = f"WITH p AS (SELECT {sql.host('url')} AS host, page_id, html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL), h AS (SELECT host, page_id, 'html5' AS tech, 100 AS c, NULL AS v FROM p WHERE regexp_matches(html, '(?i)<!doctype html>') UNION ALL SELECT host, page_id, 'tracker', 40, 'v' || regexp_extract(html, 'track\\(([0-9])([0-9]*)\\)', 1) || '.x' FROM p WHERE regexp_matches(html, 'track\\([0-9]+\\)') UNION ALL SELECT host, page_id, 'ads', 100, NULL FROM p WHERE contains(html, 'class=\"ad\"') UNION ALL SELECT host, page_id, 'numbered', 30, regexp_extract(html, 'track\\(([0-9])\\)', 1) FROM p WHERE regexp_matches(html, 'track\\([0-9]\\)')) SELECT host, tech, CAST(least(sum(c), 100) AS BIGINT) AS confidence, arg_min(v, page_id) AS version FROM h GROUP BY ALL"

QUERIES = {
    "b03_not_archived": (b03_not_archived, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey"),
    "b07_scope_list": (b07_scope_list, "SELECT event_id, 'a.example,' || event_type || '.example' AS scope FROM events"),
    "b12_redacted": (b12_redacted, f"WITH {S} SELECT page_id, ordinal, kind, CASE WHEN kind <> 'secret' THEN href END AS evidence FROM s"),
    "b13_facet_filter": (b13_facet_filter, f"WITH {E} SELECT operation, min(run_id) AS run_id FROM ep GROUP BY operation HAVING bool_or(coalesce(host IN ('example.com', 'example.org'), false)) AND min(run_id) < 4"),
    "b15_hosts_sorted": (b15_hosts_sorted, f"WITH {E} SELECT host, count(DISTINCT finding_hash) AS n FROM ep WHERE contains(host, 'e') GROUP BY host ORDER BY n DESC, host"),
    "b23_size_limits": (b23_size_limits, "WITH d AS (SELECT source, doc_id, strlen(text) AS size FROM documents WHERE text IS NOT NULL AND strlen(text) <= 10000), r AS (SELECT source, doc_id, CAST(sum(size) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, total FROM r WHERE total <= 50000 AND n <= 40"),
    "b26_transitions": (b26_transitions, f"WITH e AS (SELECT {dealt(_STATES)} AS a, {dealt(_STATES, 'user_id')} AS b FROM events) SELECT a, b, {_LEGAL} AS legal, count(*) AS n FROM e GROUP BY ALL"),
    "c01_lane_pairs": (c01_lane_pairs, f"WITH {S} SELECT {sql.host('url')} AS host, " + ", ".join(f"count(DISTINCT href) FILTER (kind = '{k}') AS n_{k}" for k in KINDS) + " FROM s GROUP BY 1"),
    "c04_asset_lookup": (c04_asset_lookup, f"WITH {S} SELECT s.page_id, ordinal, source FROM s LEFT JOIN documents d ON d.doc_id = s.page_id"),
    "c05_session_endpoints": (c05_session_endpoints, f"WITH {E} SELECT DISTINCT run_id % 3 AS session, finding_hash, value FROM ep"),
    "c07_capture_resolved": (c07_capture_resolved, f"WITH {E} SELECT DISTINCT finding_hash, operation FROM ep WHERE finding_hash IN (SELECT finding_hash FROM ep WHERE run_id = 5)"),
    "c08_latest_with_job": (c08_latest_with_job, "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY o_custkey"),
    "c09_operation_params": (c09_operation_params, f"WITH {E}, p AS (SELECT operation, array_to_string(list_sort(list_distinct(flatten(list(string_split(keys, '&'))))), ',') AS params FROM ep WHERE keys <> '' GROUP BY operation) SELECT operation, count(DISTINCT finding_hash) AS findings, any_value(params) AS params FROM ep LEFT JOIN p USING (operation) GROUP BY operation"),
    "c15_first_classified": (c15_first_classified, f"WITH {E} SELECT operation, arg_min('v' || CAST(page_id % 3 AS VARCHAR), (finding_hash, page_id)) FILTER (page_id % 3 > 0) AS verdict, arg_min(url, (finding_hash, url)) AS trace FROM ep GROUP BY operation"),
    "c16_file_findings": (c16_file_findings, "WITH e AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'input.js' WHEN event_id % 4 = 1 THEN 'src/a.js' END AS path, CASE WHEN event_id % 6 > 1 THEN 'u' || CAST(user_id % 5 AS VARCHAR) END AS asset, event_type FROM events) SELECT path, asset, count(DISTINCT event_type) AS findings FROM e WHERE path IS NOT NULL GROUP BY path, asset"),
    "c17_recovered_sources": (c17_recovered_sources, "SELECT DISTINCT 'src/' || event_type AS path, user_id % 7 AS asset FROM events WHERE event_id % 4 IN (1, 2)"),
    "d03_file_coverage": (d03_file_coverage, "SELECT 'src/' || CAST(user_id % 9 AS VARCHAR) AS path, count(*) FILTER (event_type NOT IN ('error', 'view')) AS attributed, count(*) FILTER (event_type IN ('error', 'view')) AS unattributed FROM events GROUP BY 1 ORDER BY 1"),
    "d06_last_asset": (d06_last_asset, "SELECT page_id % 8 AS run_id, CAST(sum(strlen(html)) AS BIGINT) AS attributed, arg_max(contains(html, '<nav>'), (url, page_id)) AS source_map FROM pages WHERE url IS NOT NULL GROUP BY 1"),
    "d10_percent_or_zero": (d10_percent_or_zero, "WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority <> '1-URGENT') AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN total > 0 THEN CAST(round_even(100.0 * least(done, total) / total, 0) AS BIGINT) ELSE 0 END AS percent FROM o"),
    "d13_technologies": (d13_technologies, "WITH e AS (SELECT user_id % 11 AS host, event_type, least(count(*), 100) AS c FROM events GROUP BY ALL) SELECT host, string_agg(event_type || ':' || CAST(c AS VARCHAR), ',' ORDER BY c DESC, event_type) AS technologies FROM e GROUP BY host"),
    "d15_run_scoped": (d15_run_scoped, f"WITH {E}, seen AS (SELECT finding_hash, count(DISTINCT run_id) AS n FROM ep GROUP BY 1), r AS (SELECT DISTINCT run_id, finding_hash FROM ep) SELECT run_id, count(*) FILTER (n > 2) AS documented, count(*) FILTER (n <= 2) AS shadow FROM r JOIN seen USING (finding_hash) WHERE n < 6 GROUP BY run_id"),
    "d17_request_merge": (d17_request_merge, f"WITH {E}, o AS (SELECT *, regexp_replace(operation, '^GET /(fr|de)/', 'GET /any/') AS p FROM ep) SELECT p AS path, coalesce(array_to_string(list_sort(list_distinct(list(host) FILTER (host IS NOT NULL))), ','), '') AS hosts, min(url) AS example, max(CASE WHEN contains(value, '?') THEN 'query' END) AS content FROM o GROUP BY p"),
    "d18_example_url": (d18_example_url, f"WITH {E} SELECT operation, arg_min(url, (run_id <> 3, finding_hash, page_id)) AS example_url FROM ep GROUP BY operation"),
    "d19_operation_union": (d19_operation_union, "WITH o AS (SELECT role, unnest(regexp_extract_all(text, '\\b(what|how|why|the) ([a-z]+)')) AS op FROM conversations WHERE text IS NOT NULL) SELECT DISTINCT split_part(op, ' ', 1) AS kind, split_part(op, ' ', 2) AS name, role FROM o"),
    "d21_overview": (d21_overview, f"WITH {E} SELECT count(DISTINCT page_id) AS files, count(DISTINCT finding_hash) AS endpoints, count(DISTINCT host) FILTER (ends_with(host, '.com')) AS inside, count(DISTINCT host) FILTER (NOT ends_with(host, '.com')) AS outside, CAST(round_even(100.0 * count(host) / count(*), 0) AS BIGINT) AS attributed FROM ep"),
    "d23_source_kinds": (d23_source_kinds, "SELECT count(*) FILTER (coalesce(text, '') <> '' AND coalesce(lang, '') IN ('en', 'fr')) AS fetched, count(*) FILTER (coalesce(text, '') = '') AS missing, count(*) FILTER (coalesce(text, '') <> '' AND coalesce(lang, '') = 'de') AS uploaded, count(*) FILTER (coalesce(text, '') <> '' AND coalesce(lang, '') NOT IN ('en', 'fr', 'de')) AS recovered FROM documents"),
    "d25_progress_counts": (d25_progress_counts, "WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' OR user_id % 4 = 0 AND event_type <> 'purchase' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'view' THEN 'analyzing' ELSE 'queued' END AS s FROM events) SELECT user_id, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'analyzing') AS analyzing, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed FROM e GROUP BY user_id"),
    "d26_final_state": (d26_final_state, "SELECT user_id, CASE WHEN coalesce(bool_and(value > 20) FILTER (event_type = 'signup'), true) AND coalesce(bool_and(value > 2) FILTER (event_type = 'view'), true) AND coalesce(bool_and(value > 2) FILTER (event_type = 'click'), true) THEN 'done' ELSE 'partial' END AS state FROM events GROUP BY user_id"),
    "d27_target_kinds": (d27_target_kinds, "SELECT role, count(*) AS n FROM conversations GROUP BY role"),
    "d30_fetch_summary": (d30_fetch_summary, "WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id), r AS (SELECT user_id, CAST(event_id % 5 AS VARCHAR) AS reason, count(*) AS n, min(event_id) AS f FROM events WHERE event_type = 'error' GROUP BY ALL), t AS (SELECT user_id, arg_max(reason, (n, -f)) AS top_reason FROM r GROUP BY user_id) SELECT user_id, total, ok, failed, total - ok - failed AS pending, top_reason FROM c LEFT JOIN t USING (user_id)"),
    "d31_line_marks": (d31_line_marks, f"WITH {S} SELECT page_id, ordinal // 3 AS line, arg_min(kind, ordinal) AS mark FROM s GROUP BY ALL"),
    "e01_findings_order": (e01_findings_order, f"WITH {E}, f AS (SELECT DISTINCT CASE WHEN contains(value, '?') THEN 'param' ELSE 'endpoint' END AS type, value, finding_hash FROM ep) SELECT *, row_number() OVER (PARTITION BY type ORDER BY value, finding_hash) AS place FROM f ORDER BY type, value, finding_hash"),
    "e02_occurrence_order": (e02_occurrence_order, f"WITH {S} SELECT page_id, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY CASE WHEN ordinal % 3 > 0 THEN kind ELSE '' END, CASE WHEN ordinal % 2 > 0 THEN ordinal ELSE 0 END, href, ordinal) AS ordinals FROM s GROUP BY page_id"),
    "e04_latest_job": (e04_latest_job, "SELECT l_orderkey, l_shipdate, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1"),
    "e05_latest_event": (e05_latest_event, "SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY ALL"),
    "e06_bounded_prefix": (e06_bounded_prefix, f"WITH p AS (SELECT page_id % 8 AS run_id, {sql.host('url')} AS h, row_number() OVER (PARTITION BY page_id % 8 ORDER BY url, page_id) AS k FROM pages WHERE url IS NOT NULL) SELECT run_id, arg_min(h, k) FILTER (ends_with(h, '.org')) AS host FROM p WHERE k <= 16 GROUP BY run_id"),
    "e09_recent": (e09_recent, "SELECT o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC"),
    "e10_rule_order": (e10_rule_order, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ordinal FROM orders"),
    "e13_next_line": (e13_next_line, f"WITH {S}, l AS (SELECT DISTINCT page_id, ordinal // 2 AS line FROM s) SELECT page_id, line, coalesce(lead(line) OVER (PARTITION BY page_id ORDER BY line), min(line) OVER (PARTITION BY page_id)) AS next FROM l"),
    "e14_timestamp": (e14_timestamp, "SELECT event_id, value * CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS shown FROM events"),
    "f03_unclaimed": (f03_unclaimed, f"WITH {S}, u AS (SELECT page_id, ordinal, ordinal + length(href) % 4 AS u FROM s), r AS (SELECT *, max(u) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u) SELECT page_id, ordinal FROM r WHERE reach IS NULL OR u > reach"),
    "f04_scope_equal": (f04_scope_equal, "SELECT event_id, event_id % 3 <> 0 OR event_type = 'click' AS same FROM events"),
    "f05_ordered_distinct": (f05_ordered_distinct, f"WITH {S}, f AS (SELECT page_id, href, min(ordinal) AS o FROM s GROUP BY ALL) SELECT page_id, string_agg(href, ' ' ORDER BY o) AS hrefs FROM f GROUP BY page_id"),
    "j02_field_values": (j02_field_values, f"WITH e AS (SELECT event_id, string_split({dealt(_VALUES)}, '\\;') AS p FROM events), t AS (SELECT event_id, p, list_filter(p[2:], lambda x: starts_with(x, 'version:'))[-1] AS v, list_filter(p[2:], lambda x: starts_with(x, 'confidence:'))[-1] AS c FROM e) SELECT event_id, p[1] AS pattern, substr(v, 9) AS version, coalesce(TRY_CAST(substr(c, 12) AS BIGINT), 100) AS confidence FROM t"),
    "j03_versions": (j03_versions, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'v' || event_type || '.' || CASE WHEN user_id % 2 = 0 THEN '\\1' ELSE '' END WHEN 1 THEN 'no' WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'xhas \\1' ELSE 'xnone' END WHEN 5 THEN event_type END AS version FROM events"),
    "j01_detect": (j01_detect, _TECH),
    "j09_categories": (j09_categories, "SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'CMS,' WHEN 6 THEN 'Ecommerce,' WHEN 10 THEN 'Analytics,' ELSE '' END || 'Ecommerce' AS categories FROM events"),
    "k10_base_stripped": (k10_base_stripped, f"SELECT page_id, '/' || coalesce(array_to_string(list_concat({sql.segments(f'regexp_extract(url, {sql.URL}, 3)')}, CASE WHEN page_id % 2 = 0 THEN ['${{slug}}'] ELSE [] END), '/'), '') AS path FROM pages WHERE url IS NOT NULL"),
    "k14_probe_host": (k14_probe_host, f"WITH {E} SELECT operation, coalesce(array_to_string(list_sort(list_distinct(list(host) FILTER (run_id > 5 AND host IS NOT NULL))), ','), 'probe.example') AS hosts FROM ep GROUP BY operation"),
    "k15_canonical_path": (k15_canonical_path, None),
    "k17_security": (k17_security, f"WITH e AS (SELECT {dealt(['Authorization', 'X-Api-Key', 'authorization'])} AS h, lower({dealt(['Bearer', 'Basic', '', 'Custom'], 'user_id')}) AS s FROM events) SELECT CASE WHEN lower(h) = 'authorization' AND s IN ('bearer', 'basic') THEN 'http:' || s ELSE 'apiKey:' || h END AS scheme, count(*) AS n FROM e GROUP BY 1"),
    "l02_last_writer": (l02_last_writer, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "l05_cascade_delete": (l05_cascade_delete, "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY l_returnflag"),
    "l06_rename": (l06_rename, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed ' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS name FROM customer"),
    "l07_clone_decision": (l07_clone_decision, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b.example' ELSE 'a.example' END AS target, event_id % 4 = 0 OR event_id % 3 = 0 AS fork FROM events"),
    "l08_rule_deleted": (l08_rule_deleted, f"WITH {E} SELECT DISTINCT operation, CASE WHEN starts_with(split_part(operation, ' ', 2), '/de') THEN '/de' ELSE '/' END AS prefix FROM ep"),
    "l09_control": (l09_control, f"WITH e AS (SELECT {dealt(['queued', 'analyzing', 'paused', 'done', 'failed'])} AS s, {dealt(['pause', 'cancel', 'resume'], 'user_id')} AS w FROM events) SELECT s AS state, w AS wish, CASE WHEN s IN ('done', 'failed') THEN CASE WHEN w = 'cancel' THEN 'kept' ELSE 'error' END WHEN w = 'pause' THEN CASE s WHEN 'queued' THEN 'paused' WHEN 'paused' THEN 'kept' ELSE 'requested' END WHEN w = 'cancel' THEN CASE WHEN s IN ('queued', 'paused') THEN 'cancelled' ELSE 'requested' END WHEN s = 'paused' THEN 'resumed' ELSE 'error' END AS outcome, count(*) AS n FROM e GROUP BY ALL"),
    "m07_absolute_max": (m07_absolute_max, "SELECT user_id, max(value) AS total, arg_max(event_type, (value, event_id)) AS last_host FROM events GROUP BY user_id"),
}
