"""Sessions classified against their descriptions, and findings as they are recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import records, sessions
from basalt.plans import models, sql
from basalt.sources.shared import cut
from basalt.sources.views import endpoints, links, table

OPERATIONS = (*models.DOCUMENTED, "GET /v1/fr/{id}", "GET /edge/en/{code}", "GET /x/de/{id}")
#: session, prefix, base, recency.
PREFIXES = ((0, "/fr", "https://api.example.com/v1", 1), (0, "/", "/edge", 2), (1, "/de/", "//cdn.example.com/x/", 1), (2, "/", "/edge", 1), (2, "/", "/v1/", 2), (3, "/", "/never", 1))


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a sighting in one of four sessions; some paths start with a variable, few have a host or come from capture."""
    n, open_ = F.col("page_id"), F.pmod("page_id", F.lit(7)) == 0
    ep = endpoints(spark, sf)
    return ep.select("page_id", F.pmod("run_id", F.lit(4)).alias("session"), F.when(open_, F.concat(F.lit("v"), "finding_hash")).otherwise(F.col("finding_hash")).alias("finding_hash"), F.when(open_, F.concat(F.lit("GET /${api}"), F.substring("operation", 5, 1 << 30))).otherwise(F.col("operation")).alias("operation"), F.when(F.col("run_id") > 5, F.col("host")).alias("host"), F.when(n % 11 == 0, "capture").otherwise("static").alias("engine"))


def _rules(spark: SparkSession, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    chosen = seen.where("session = 1 AND page_id % 13 = 0")
    selections = chosen.select("session", "finding_hash", F.when(F.col("page_id") % 2 == 0, "/edge").otherwise("https://sel.example.com/v2/").alias("base_url"), F.col("page_id").alias("recency"))
    return selections, spark.createDataFrame(list(PREFIXES), "session long, path_prefix string, base_url string, recency long")


def k12_rebased(spark: SparkSession, sf: str) -> DataFrame:
    """The path of each session's finding behind its base."""
    seen = cut(_sightings(spark, sf), "sightings")
    return sessions.rebased(cut(sessions.findings_of(seen), "findings"), *_rules(spark, seen)).select("session", "finding_hash", "base_url", "base_host", "path")


def k11_session_status(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of three sessions over the verdicts of an earlier, shorter description."""
    seen = cut(_sightings(spark, sf), "sightings")
    rules = _rules(spark, seen)
    documented = lambda ref, ops: spark.createDataFrame([(s, ref, k, op) for s in range(3) for k, op in enumerate(ops)], "session long, spec_ref string, ord int, operation string")
    before = sessions.verdicts(seen.where("page_id % 3 > 0"), *rules, documented("s1", models.DOCUMENTED[:2]))
    return sessions.upserted(before, sessions.verdicts(seen, *rules, documented("s2", OPERATIONS)))


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Links as sightings of findings with all attributes."""
    n, k = F.col("page_id"), F.col("ordinal").cast("long")
    has_kind = k % 5 > 0
    auth = F.array_compact(F.array(F.when(n % 4 == 1, F.struct(F.lit("Authorization").alias("name"), F.when(n % 8 == 1, "bearer").alias("scheme"))), F.when(k % 6 == 2, F.struct(F.concat(F.lit("X-"), (n % 3).cast("string")).alias("name"), F.lit(None).cast("string").alias("scheme")))))
    tags = F.array_compact(F.array(F.when(n % 5 == 0, "idor"), F.when(k % 3 == 0, "auth")))
    return links(spark, sf).select(
        "run_id", F.sha2("href", 256).alias("finding_hash"), (n * 1000000 + k).alias("ord"), F.lit("endpoint").alias("type"), F.col("href").alias("value"), F.concat(F.lit("src/"), (n % 9).cast("string")).alias("path"), F.when(n % 2 == 0, "low").alias("severity"), F.lit("analyze").alias("first_stage"),
        auth.alias("auth"), tags.alias("risk_tags"), has_kind.alias("has_kind"), F.when(has_kind & (n % 16 != 3), F.when(n % 16 < 8, "fetch").otherwise("xhr")).alias("kind"), F.when(k % 4 == 1, F.concat(F.lit("w"), (n % 6).cast("string"))).alias("wrapper"),
        F.col("href").alias("raw_url"), F.when(n % 3 > 0, F.concat(F.lit("hé"), (n % 3).cast("string"))).alias("host"), F.concat(F.lit("src/中\"\\\t"), (n % 9).cast("string")).alias("source_path"), F.when(k % 2 == 0, k).alias("offset_start"), F.when(k % 2 == 0, k + 9).alias("offset_end"), F.when(k % 2 == 1, k % 10).alias("line"), F.lit(1).cast("long").alias("col"), F.when(n % 2 == 0, "\U0001f600/a.js").alias("asset_url"),
        F.concat(F.lit("seen at "), n.cast("string")).alias("evidence"), F.lit("static").alias("engine"), F.lit("certain").alias("confidence"), F.lit(None).cast("boolean").alias("verified"),
    )


def d01_recorded_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings after two batches, the second one twice."""
    seen = _recorded(spark, sf)
    late = seen.where("ord % 2 = 1")
    out = records.findings(late, records.findings(late, records.findings(seen.where("ord % 2 = 0").withColumn("ord", F.col("ord") - F.lit(1 << 60)))))
    heads = F.array_join(F.transform("auth", lambda a: F.concat(a["name"], F.lit(":"), F.coalesce(a["scheme"], F.lit("")))), ",")
    return out.select("run_id", "finding_hash", "value", "path", "severity", heads.alias("auth"), F.array_join("risk_tags", ",").alias("risk_tags"), "kind", "wrapper")


def d02_recorded_places(spark: SparkSession, sf: str) -> DataFrame:
    return records.places(_recorded(spark, sf)).select("run_id", "finding_hash", "occurrence_hash", "evidence")


def c16_findings_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Links' words as findings in files of three kinds."""
    n = F.col("page_id")
    asset = F.when(n % 5 > 1, F.concat(F.lit("u"), (n % 40).cast("string")))
    seen = links(spark, sf).select(F.col("href").alias("finding_hash"), F.when(n % 4 == 0, "input.js").otherwise(F.concat(F.lit("src/"), (n % 12).cast("string"))).alias("source_path"), asset.alias("asset_url"))
    pages = table(spark, sf, "pages").where("page_id IS NOT NULL")
    kind = F.when(n % 3 == 0, "asset").when(n % 3 == 1, "source").otherwise("upload")
    path = F.when(kind == "asset", F.concat(F.lit("u"), (n % 40).cast("string"))).when(kind == "source", F.concat(F.lit("src/"), (n % 12).cast("string"))).otherwise(F.concat(F.lit("src/"), (n % 2).cast("string")))
    return records.file_findings(pages.select(kind.alias("kind"), path.alias("path"), asset.alias("asset_url")), seen)


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    files = F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("f"), (n % 5 + i).cast("string")).alias("path"), (n % 4 + i).cast("long").alias("attributed"), F.when(n % 2 == 0, n % 7).alias("unattributed")))
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), n.alias("id"), (n % 9).alias("attributed"), F.when(n % 4 > 0, n % 5).alias("unattributed"), (n % 2).alias("secrets"), F.when(F.col("event_type") == "error", "unavailable").otherwise("ok").alias("secrets_engine"), (n % 6).alias("sources_recovered"), F.col("event_type").alias("source_map"), F.when(n % 6 > 0, files).alias("files"))


def d04_run_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return records.run_coverage(_coverage(spark, sf))


def d04_run_files(spark: SparkSession, sf: str) -> DataFrame:
    return records.run_files(_coverage(spark, sf))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(sql.quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_BASE_PATH = f"regexp_replace(CASE WHEN contains(base, '//') THEN regexp_extract(base, {sql.URL}, 3) ELSE base END, '/+$', '')"
REBASED = f"""WITH {sql.ENDPOINTS},
s AS (SELECT page_id, run_id % 4 AS session, CASE WHEN page_id % 7 = 0 THEN 'v' || finding_hash ELSE finding_hash END AS finding_hash, CASE WHEN page_id % 7 = 0 THEN 'GET /${{api}}' || substr(operation, 5) ELSE operation END AS operation, CASE WHEN run_id > 5 THEN host END AS host FROM ep),
a AS (SELECT session, operation, bool_or(host IS NOT NULL) AS absolute FROM s GROUP BY ALL),
f AS (SELECT session, finding_hash, operation, substr(operation, 5) AS own, bool_or(page_id % 11 = 0) AS captured FROM s GROUP BY ALL),
sel AS (SELECT session, finding_hash, arg_max(CASE WHEN page_id % 2 = 0 THEN '/edge' ELSE 'https://sel.example.com/v2/' END, page_id) AS base FROM s WHERE session = 1 AND page_id % 13 = 0 GROUP BY ALL),
pre AS (SELECT session, {sql.segments("prefix")} AS lead, base, recency FROM {_values(PREFIXES)} t(session, prefix, base, recency)),
best AS (SELECT session, own, arg_max(base, (len(lead), recency)) AS base FROM (SELECT DISTINCT session, own FROM f) JOIN pre USING (session) WHERE {sql.segments("own")}[:len(lead)] = lead GROUP BY ALL),
r AS (SELECT f.*, CASE WHEN NOT captured AND NOT absolute THEN coalesce(sel.base, best.base) END AS base FROM f JOIN a USING (session, operation) LEFT JOIN sel USING (session, finding_hash) LEFT JOIN best USING (session, own)),
placed AS (SELECT session, finding_hash, operation, base, CASE WHEN captured AND starts_with(own, '/${{') THEN '/' || array_to_string({sql.segments("own")}[2:], '/') WHEN captured THEN '/' || array_to_string({sql.segments("own")}, '/')
  WHEN base IS NOT NULL AND {sql.segments("own")}[:len({sql.segments(_BASE_PATH)})] <> {sql.segments(_BASE_PATH)} THEN {_BASE_PATH} || own ELSE own END AS path FROM r)"""
K12 = REBASED + f" SELECT session, finding_hash, base AS base_url, CASE WHEN contains(base, '//') THEN regexp_extract(base, {sql.URL}, 2) END AS base_host, path FROM placed"
_SEGS = models._WILD.format(sql.segments("path"))


def _verdict(name: str, rows: str, ops: tuple[str, ...], ref: str) -> str:
    return f"""{name}_d AS (SELECT ord, doc, split_part(doc, ' ', 1) AS method, {models._WILD.format(sql.segments("substr(doc, position(' ' IN doc) + 1)"))} AS segs FROM {_values(enumerate(ops))} t(ord, doc)),
{name}_o AS (SELECT *, {_SEGS} AS segs FROM placed WHERE session < 3 AND (session, finding_hash) IN ({rows})),
{name}_m AS (SELECT session, finding_hash, d.ord, d.doc, CASE WHEN method = 'GET' AND o.segs = d.segs THEN 1 WHEN method = 'GET' AND len(o.segs) > 0 AND len(o.segs) < len(d.segs) AND d.segs[len(d.segs) - len(o.segs) + 1:] = o.segs THEN 2
  WHEN method = 'GET' AND len(d.segs) > 0 AND len(d.segs) < len(o.segs) AND o.segs[len(o.segs) - len(d.segs) + 1:] = d.segs THEN 2 WHEN method <> 'GET' AND o.segs = d.segs THEN 3 END AS step FROM {name}_o o JOIN {name}_d d ON true),
{name}_p AS (SELECT session, finding_hash, min(step) AS step, arg_min(doc, (step, ord)) AS doc FROM {name}_m WHERE step IS NOT NULL GROUP BY ALL),
{name} AS (SELECT o.session, o.finding_hash, CASE WHEN starts_with(path, '/${{') THEN 'partial' ELSE ['documented', 'suffix-verify', 'undocumented-method', 'undocumented-path'][coalesce(step, 4)] END AS reason,
  CASE reason WHEN 'documented' THEN reason WHEN 'undocumented-method' THEN 'shadow' WHEN 'undocumented-path' THEN 'shadow' ELSE 'unresolved' END AS status, CASE WHEN reason <> 'partial' THEN doc END AS matched, '{ref}' AS spec_ref FROM {name}_o o LEFT JOIN {name}_p p USING (session, finding_hash))"""


# the earlier verdicts know fewer sightings, so hosts, captures and selections of those alone
_EARLY = REBASED.replace("FROM ep),", "FROM ep WHERE page_id % 3 > 0),", 1).replace("FROM s WHERE session = 1", "FROM every WHERE session = 1", 1)
_EARLY = _EARLY.replace("\na AS (", "\nevery AS (SELECT page_id, run_id % 4 AS session, CASE WHEN page_id % 7 = 0 THEN 'v' || finding_hash ELSE finding_hash END AS finding_hash FROM ep),\na AS (", 1)
_ALL = "SELECT session, finding_hash FROM placed"
K11 = f"""WITH old AS ({_EARLY}, {_verdict("v1", _ALL, models.DOCUMENTED[:2], "s1")} SELECT * FROM v1), new AS ({REBASED}, {_verdict("v2", _ALL, OPERATIONS, "s2")} SELECT * FROM v2)
SELECT session, finding_hash, coalesce(n.status, o.status) AS status, coalesce(n.reason, o.reason) AS reason, CASE WHEN n.status IS NOT NULL THEN n.matched ELSE o.matched END AS matched, coalesce(n.spec_ref, o.spec_ref) AS spec_ref,
  n.status IS NOT NULL AND (n.status IS DISTINCT FROM o.status OR n.reason IS DISTINCT FROM o.reason OR n.matched IS DISTINCT FROM o.matched OR n.spec_ref IS DISTINCT FROM o.spec_ref) AS changed FROM new n FULL JOIN old o USING (session, finding_hash)"""

_SEEN = f"""WITH {sql.LINKS}, k AS (SELECT page_id AS n, ordinal AS k, run_id, href, sha256(href) AS finding_hash, page_id * 1000000 + ordinal AS ord, ((page_id * 1000000 + ordinal) % 2, page_id * 1000000 + ordinal) AS turn FROM links)"""
D01 = f"""{_SEEN}, h AS (SELECT run_id, finding_hash, unnest(list_filter([CASE WHEN n % 4 = 1 THEN (1, 'Authorization:' || CASE WHEN n % 8 = 1 THEN 'bearer' ELSE '' END) END, CASE WHEN k % 6 = 2 THEN (2, 'X-' || CAST(n % 3 AS VARCHAR) || ':') END], lambda x: x IS NOT NULL)) AS a, turn FROM k),
h1 AS (SELECT run_id, finding_hash, a[2] AS a, min((turn, a[1])) AS spot FROM h GROUP BY run_id, finding_hash, a[2]), h2 AS (SELECT run_id, finding_hash, string_agg(a, ',' ORDER BY spot) AS auth FROM h1 GROUP BY ALL),
t AS (SELECT run_id, finding_hash, concat_ws(',', CASE WHEN bool_or(k % 3 = 0) THEN 'auth' END, CASE WHEN bool_or(n % 5 = 0) THEN 'idor' END) AS risk_tags,
  CASE WHEN bool_and(n % 16 <> 3) FILTER (k % 5 > 0) AND count(DISTINCT n % 16 < 8) FILTER (k % 5 > 0) = 1 THEN CASE WHEN bool_and(n % 16 < 8) FILTER (k % 5 > 0) THEN 'fetch' ELSE 'xhr' END END AS kind,
  arg_min('w' || CAST(n % 6 AS VARCHAR), turn) FILTER (k % 4 = 1) AS wrapper, arg_min(href, turn) AS value, arg_min('src/' || CAST(n % 9 AS VARCHAR), turn) AS path, CASE WHEN arg_min(n % 2, turn) = 0 THEN 'low' END AS severity FROM k GROUP BY ALL)
SELECT t.*, coalesce(h2.auth, '') AS auth FROM t LEFT JOIN h2 USING (run_id, finding_hash)"""
D02 = f"""{_SEEN}, j AS (SELECT *, '{{"asset_url":' || CASE WHEN n % 2 = 0 THEN '"\\ud83d\\ude00/a.js"' ELSE 'null' END || ',"col":1,"host":' || CASE WHEN n % 3 > 0 THEN '"h\\u00e9' || CAST(n % 3 AS VARCHAR) || '"' ELSE 'null' END || ',"line":' || CASE WHEN k % 2 = 1 THEN CAST(k % 10 AS VARCHAR) ELSE 'null' END || ',"offset_end":' || CASE WHEN k % 2 = 0 THEN CAST(k + 9 AS VARCHAR) ELSE 'null' END || ',"offset_start":' || CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'null' END || ',"raw_url":"' || {sql.json_text("href")} || '","source_path":"src/\\u4e2d\\"\\\\\\t' || CAST(n % 9 AS VARCHAR) || '"}}' AS j FROM k)
SELECT run_id, finding_hash, sha256(j) AS occurrence_hash, 'seen at ' || CAST(arg_min(n, ord) AS VARCHAR) AS evidence FROM j GROUP BY run_id, finding_hash, j"""
C16 = f"""WITH {sql.LINKS}, o AS (SELECT DISTINCT href, CASE WHEN page_id % 4 = 0 THEN 'input.js' ELSE 'src/' || CAST(page_id % 12 AS VARCHAR) END AS source_path, CASE WHEN page_id % 5 > 1 THEN 'u' || CAST(page_id % 40 AS VARCHAR) END AS asset_url FROM links),
f AS (SELECT DISTINCT page_id % 3 AS kind, CASE page_id % 3 WHEN 0 THEN 'u' || CAST(page_id % 40 AS VARCHAR) WHEN 1 THEN 'src/' || CAST(page_id % 12 AS VARCHAR) ELSE 'src/' || CAST(page_id % 2 AS VARCHAR) END AS path, CASE WHEN page_id % 5 > 1 THEN 'u' || CAST(page_id % 40 AS VARCHAR) END AS asset_url FROM pages)
SELECT path, count(DISTINCT href) AS findings FROM f JOIN o ON CASE kind WHEN 0 THEN o.asset_url = path WHEN 1 THEN o.source_path = path AND o.asset_url IS NOT DISTINCT FROM f.asset_url ELSE o.source_path = 'input.js' AND o.asset_url IS NULL END GROUP BY path"""
D04 = "SELECT user_id AS run_id, CAST(sum(event_id % 9) AS BIGINT) AS attributed, CAST(sum(CASE WHEN event_id % 4 > 0 THEN event_id % 5 ELSE 0 END) AS BIGINT) AS unattributed, CAST(sum(event_id % 2) AS BIGINT) AS secrets, CASE WHEN bool_or(event_type = 'error') THEN 'unavailable' ELSE 'ok' END AS secrets_engine, CAST(sum(event_id % 6) AS BIGINT) AS sources_recovered, arg_max(event_type, event_id) AS source_map, CAST(sum(CASE WHEN event_id % 6 > 0 THEN event_id % 3 + 1 ELSE 0 END) AS BIGINT) AS files FROM events GROUP BY user_id"
FILES = "WITH x AS (SELECT user_id, event_id AS n, unnest(range(event_id % 3 + 1)) AS i FROM events WHERE event_id % 6 > 0) SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, i) AS place, 'f' || CAST(n % 5 + i AS VARCHAR) AS path, n % 4 + i AS attributed, CASE WHEN n % 2 = 0 THEN n % 7 ELSE 0 END AS unattributed FROM x"

QUERIES = {
    "k11_session_status": (k11_session_status, K11),
    "k12_rebased": (k12_rebased, K12),
    "d01_recorded_findings": (d01_recorded_findings, D01),
    "d02_recorded_places": (d02_recorded_places, D02),
    "c16_findings_of_files": (c16_findings_of_files, C16),
    "d04_run_coverage": (d04_run_coverage, D04),
    "d04_run_files": (d04_run_files, FILES),
}
