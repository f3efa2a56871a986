"""Queries over identities, classes and display labels. Values that the tables lack are dealt from lists by event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import identity, labels, normalize, urls
from basalt.plans import sql
from basalt.sources.views import endpoints, links, table

NAMES = ["userId", "api_key", "nextPageToken", "APIToken", "isEnabled", "valid", "android", "session-storage", "x.session", "adminUser", "guid", "HTTPSProxy", "betaFlag", "password", "", "pageOffset"]
MESSAGES = ["HTTP 403 for https://a.io", "HTTP 429", "got HTTP 503 back", "HTTP 404", "not in engagement scope: cdn.example.net", "not in engagement scope: 10.0.0.7", "not in engagement scope: 8.8.8.8", "DNS resolution failed for gone.example", "no addresses resolved for void.example", "resolved to non-public address 10.1.2.3", "not authorized for network", "malformed URL", "missing host", "read timed out", "deadline exceeded", "body exceeds 10485760 bytes", "boom"]
ADDRESSES = ["8.8.8.8", "10.0.0.7", "100.64.1.1", "172.31.255.255", "172.32.0.1", "169.254.169.254", "::ffff:127.0.0.1", "::ffff:1.1.1.1", "224.0.0.1", "1.2.3", "300.1.1.1", "host.example", "192.0.2.9", "198.19.0.1", "255.255.255.255"]
RULE_IDS = ["kingfisher.stripe.2", "custom.aws.akia_standalone", "kingfisher", "github-token_1", " Custom/Rule ", "", "..."]
SOURCES = ["webpack://App/./src/../lib/app.9f8e7d6c.js", "webpack:/js/Utf8Decoder.js", "a/b/../../c\\d.js", "src/decade.js", "x/chunk-aB3dE5fG7hJ9.js", "https://CDN.example/a//b/main.0123456789ab.min.js", "  ", "..", "index.aaaaaaaaaa.js", "dead1beef"]
TARGETS = ["example.com", "https://a.example/x y", "b.example:8443/path", "https://user@C.Example/", "http://d.example", "localhost/x?q"]
CALLEES = ["api.client", "$http", "a..b", "1x", "this.api.get", "a-b", ""]
BASES = ["/v1", "https://api.example.com/v2", "ftp://x", "https://u@h/", "https://", "/a?b=1", "v1", "//host/x", ""]
REFS = ["./a.js", "../b/c.js", "/root.js", "https://cdn.example/x.js", "react", "//cdn.example/y.js", "../../up.js"]
PROBLEMS = ["HTTP 404 Not Found", "http 403", "HTTP 401", "net::ERR", ""]
ASSETS = ["https://www.google-analytics.com/x.js", "https://a.example/wp-content/p.js", "https://a.example/js/jquery-3.js", "https://a.example/app/gtag.js", "https://a.example/main.js", "https://a.example/lib/vendors~main.js", "https://a.example/wp-x/a", "https://a.example/app.min.js", "https://a.example/chunk/1?f=x.JS", "https://a.example/style.css"]
STATES = ["queued", "discovering", "analyzing", "paused", "failed", "done", "partial", "correlating"]
FRAMES = [": keep-alive", "id: 7\nevent: run.transition\ndata: {\"to\":\"done\"}", "event: job.progress\ndata: {\"done\":\ndata: 3}", "  ", "data: x"]


def pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def dealt(values: list[str], by: str = "event_id") -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{items}][CAST({by} % {len(values)} AS BIGINT) + 1]"


def _events(spark: SparkSession, sf: str, values: list[str]) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", pick(values, F.col("event_id")).alias("x"))


def _one(values: list[str], name: str, made):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _events(spark, sf, values).select("event_id", made(F.col("x")).alias(name))

    return query


def _one_sql(values: list[str], name: str, made: str) -> str:
    return f"WITH e AS (SELECT event_id, {dealt(values)} AS x FROM events) SELECT event_id, {made} AS {name} FROM e"


def b08_public_address(spark: SparkSession, sf: str) -> DataFrame:
    return _one(ADDRESSES, "public", labels.public_ipv4)(spark, sf)


def _headers() -> Column:
    return F.create_map(F.lit("server"), F.col("event_type"), F.lit("set-cookie"), F.lit("secret"), F.lit("www-authenticate"), F.concat(F.lit(" Negotiate "), "event_type"), F.lit("x-fastly-debug"), F.repeat("event_type", F.lit(4000)))


def b10_kept_headers(spark: SparkSession, sf: str) -> DataFrame:
    kept = labels.kept_headers(_headers())
    rows = table(spark, sf, "events").select("event_id", kept.alias("h"))
    return rows.select("event_id", F.array_join(F.array_sort(F.map_keys("h")), ",").alias("names"), F.try_element_at("h", F.lit("www-authenticate")).alias("scheme"), F.length(F.try_element_at("h", F.lit("x-fastly-debug"))).cast("long").alias("n_debug"))


def b11_cookie_names(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array(F.concat(F.col("event_type"), F.lit("=1; Path=/")), F.lit(" sid = x=y"), F.lit("flag"), F.lit("=z"), F.concat(F.lit("a"), F.pmod("event_id", F.lit(3)).cast("string"), F.lit("=b")))
    return table(spark, sf, "events").select("event_id", F.array_join(labels.cookie_names(lines), ",").alias("names"))


def b20_asset_class(spark: SparkSession, sf: str) -> DataFrame:
    return _one(ASSETS, "class", labels.asset_class)(spark, sf)


def b22_script_like(spark: SparkSession, sf: str) -> DataFrame:
    return _one(ASSETS, "script", labels.script_like)(spark, sf)


def b27_display_source(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.pmod("event_id", F.lit(3)) == 0, "input.js").when(F.pmod("event_id", F.lit(3)) == 1, "src/a.js")
    asset = F.when(F.pmod("event_id", F.lit(5)) < 2, pick(ASSETS, F.col("event_id")))
    host = F.when(F.pmod("event_id", F.lit(2)) == 0, "h.example")
    return table(spark, sf, "events").select("event_id", labels.occurrence_source(path, asset, host).alias("source"))


def g08_param_value(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.explode(F.split(F.split_part("value", F.lit("?"), F.lit(2)), "&")).alias("name")
    rows = endpoints(spark, sf, hashed=False).where(F.contains("value", F.lit("?"))).select("page_id", "operation", keys)
    value = normalize.param_value(F.col("operation"), F.lit("query"), F.col("name"))
    return rows.select("page_id", value.alias("value"), (urls.operation_of_param(value) == F.col("operation")).alias("inverse"))


def g10_secret_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf, RULE_IDS)
    token = F.concat(F.lit("\"'("), "event_type", F.lit("=-x;\n"))
    return rows.select("event_id", normalize.secret_value(token, F.col("x")).alias("value"))


def g11_provider(spark: SparkSession, sf: str) -> DataFrame:
    return _one(RULE_IDS, "provider", normalize.provider)(spark, sf)


def g12_source_path(spark: SparkSession, sf: str) -> DataFrame:
    return _one(SOURCES, "path", normalize.source_path)(spark, sf)


def g13_collapsed_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("app."), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 9), F.lit("-"), "event_type", F.lit(".js"))
    return table(spark, sf, "events").select("event_id", normalize.collapse_hashes(name).alias("name"))


def g15_occurrence_hash(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = F.when(F.pmod("event_id", F.lit(4)) > 0, F.col("event_id"))
    hashed = identity.occurrence_hash(kind=F.col("event_type"), host=F.lit(None).cast("string"), offset_start=start, offset_end=start + 5, run_id=F.col("user_id").cast("string"))
    return e.select("event_id", hashed.alias("occurrence_hash"))


def g18_attributed_host(spark: SparkSession, sf: str) -> DataFrame:
    made = F.when(F.pmod("event_id", F.lit(5)) == 4, F.lit("https://EXPR.example.com/x")).otherwise(normalize.navigable_url(F.col("x")))
    return _events(spark, sf, TARGETS).select("event_id", normalize.attributed_host(made).alias("host"))


def g19_target_host(spark: SparkSession, sf: str) -> DataFrame:
    return _one(TARGETS, "host", normalize.target_host)(spark, sf)


def g21_resolve_reference(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", normalize.resolve_reference(pick(REFS, F.col("page_id")), F.col("url")).alias("resolved"))
    return rows


def g28_minified_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", labels.minified_by_shape(F.col("text")).alias("minified"))


def g31_stalled(spark: SparkSession, sf: str) -> DataFrame:
    w = F.lead("ts").over(_by_user())
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type", w.alias("now"))
    return rows.select("event_id", labels.stalled(F.col("event_type") != "purchase", F.col("ts"), F.coalesce("now", "ts"), 3600).alias("stalled"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def g33_retryable(spark: SparkSession, sf: str) -> DataFrame:
    status = F.lit(395) + F.pmod("event_id", F.lit(220))
    return table(spark, sf, "events").select("event_id", labels.retryable(status).alias("again"))


def g34_failure(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf, MESSAGES).select(labels.failure(F.col("x")).alias("f"))
    return rows.groupBy(F.col("f.category").alias("category"), F.col("f.host").alias("host"), F.col("f.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def g35_clamped(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.when(F.pmod("event_id", F.lit(7)) > 0, F.pmod("event_id", F.lit(90)) - 10)
    return table(spark, sf, "events").select("event_id", labels.clamped(wanted, 20, 60).cast("long").alias("bytes"))


def g39_risk_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _one(NAMES, "tags", lambda x: F.array_join(labels.risk_tags(x), ","))(spark, sf)


def g40_callee(spark: SparkSession, sf: str) -> DataFrame:
    return _one(CALLEES, "valid", labels.callee_valid)(spark, sf)


def g41_base_url(spark: SparkSession, sf: str) -> DataFrame:
    return _one(BASES, "valid", labels.base_url_valid)(spark, sf)


def g42_node_statuses(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.pmod("user_id", F.lit(4)) > 0, pick(list(labels.STAGES), F.col("user_id")))
    return _events(spark, sf, STATES).select("event_id", F.array_join(labels.node_statuses(F.col("x"), stage), ",").alias("nodes"))


def g43_source_map_error(spark: SparkSession, sf: str) -> DataFrame:
    return _one(PROBLEMS, "class", labels.source_map_error)(spark, sf)


def g44_bare_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _one(TARGETS, "bare", normalize.bare_domain)(spark, sf)


def g45_type_label(spark: SparkSession, sf: str) -> DataFrame:
    return _one(["endpoint", "endpoint_generic", "endpoint_unresolved", "page_route", "secret"], "label", labels.type_label)(spark, sf)


def g46_relative_time(spark: SparkSession, sf: str) -> DataFrame:
    then = F.when(F.pmod("event_id", F.lit(6)) > 0, F.col("ts"))
    now = F.col("ts") + F.make_dt_interval(secs=F.pow(F.lit(1.7), F.pmod("event_id", F.lit(28))).cast("decimal(18,6)"))
    return table(spark, sf, "events").select("event_id", labels.relative_time(then, now).alias("ago"))


def g47_navigable_url(spark: SparkSession, sf: str) -> DataFrame:
    return _one(TARGETS, "url", normalize.navigable_url)(spark, sf)


def e11_card_label(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    name = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit(" n"), k.cast("string"))).when(F.pmod(k, F.lit(3)) == 1, F.lit("ext"))
    label = labels.card_label(name, F.lit("ext"), F.when(F.pmod(k, F.lit(5)) == 0, "t.example"), F.when(F.pmod(k, F.lit(7)) == 0, "a.example"), F.when(F.pmod(k, F.lit(2)) == 0, F.array(F.lit("s.example"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf, "events").select("event_id", label.alias("label"))


def m14_sse_frames(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("x", "\n")

    def field(name: str) -> Column:
        return F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit(name + ":"))), lambda s: F.trim(F.substring(s, F.lit(len(name) + 2), F.length(s))))

    rows = _events(spark, sf, FRAMES).where((F.trim("x") != "") & ~F.startswith("x", F.lit(":")))
    rows = rows.select("event_id", F.coalesce(F.try_element_at(field("id"), F.lit(-1)), F.lit("")).alias("id"), F.coalesce(F.try_element_at(field("event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field("data"), "").alias("data"))
    return rows.withColumn("ends", F.coalesce((F.col("event") == "run.transition") & F.get_json_object("data", "$.to").isin(*labels.TERMINAL), F.lit(False)))


def b02_lanes(spark: SparkSession, sf: str) -> DataFrame:
    kind = pick(["endpoint", "endpoint_generic", "endpoint_unresolved", "page_route", "secret"], F.col("ordinal"))
    rows = links(spark, sf).select(urls.host(F.col("url")).alias("host"), kind.alias("kind"))
    lane = F.when(F.col("kind") == "endpoint", "confirmed").when(F.col("kind").isin("endpoint_generic", "endpoint_unresolved"), "unconfirmed").when(F.col("kind") == "page_route", "route")
    return rows.where(lane.isNotNull()).groupBy("host", lane.alias("lane")).agg(F.count(F.lit(1)).alias("n"))


E, L = sql.ENDPOINTS, sql.LINKS
_IPV4 = "'" + labels.IPV4 + "'"
_BLOCKS = " OR ".join(f"n BETWEEN {sum(int(x) << (24 - 8 * k) for k, x in enumerate(b.split('/')[0].split('.')))} AND {sum(int(x) << (24 - 8 * k) for k, x in enumerate(b.split('/')[0].split('.'))) + (1 << (32 - int(b.split('/')[1]))) - 1}" for b in labels.NOT_PUBLIC)
_NUMBER = "list_reduce(list_transform(string_split(p, '.'), lambda o: TRY_CAST(o AS BIGINT)), lambda a, o: a * 256 + o)"
_PUBLIC = f"(WITH q AS (SELECT regexp_replace(lower(@), '^::ffff:', '') AS p), r AS (SELECT p, {_NUMBER} AS n FROM q) SELECT coalesce(regexp_matches(p, {_IPV4}) AND NOT ({_BLOCKS}), false) FROM r)"
_PROVIDER = "CASE WHEN lower(trim(x)) = 'custom.aws.akia_standalone' THEN 'aws' WHEN s[1] = 'kingfisher' THEN coalesce(s[2], 'unknown') ELSE coalesce(s[1], 'unknown') END"
_RULES = f"e AS (SELECT event_id, event_type, x, list_filter(regexp_split_to_array(lower(trim(x)), '[./_-]'), lambda p: p <> '') AS s FROM (SELECT event_id, event_type, {dealt(RULE_IDS)} AS x FROM events))"


def _collapsed(name: str) -> str:
    parts = f"list_filter(regexp_split_to_array({name}, '[._-]'), lambda p: p <> '')"
    gaps = f"regexp_split_to_array({name}, '[^._-]+')"
    hexed = "regexp_matches(p, '^[0-9a-fA-F]{6,}$') AND regexp_matches(p, '[0-9]')"
    wordish = f"i > 1 AND regexp_matches(p, '^[A-Za-z0-9]{{8,}}$') AND {sql.entropy('p')} >= 3.0"
    one = f"CASE WHEN NOT (i = len({parts}) AND len({parts}) > 1) AND ({hexed} OR {wordish}) THEN '{{hash}}' ELSE p END"
    return f"array_to_string(list_transform(list_zip({gaps}, list_transform({parts}, lambda p, i: {one})), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"


_SOURCE = f"""WITH e AS (SELECT event_id, trim({dealt(SOURCES)}) AS x FROM events),
s AS (SELECT event_id, x, regexp_matches(x, '(?s)^[a-zA-Z][a-zA-Z0-9+.-]*:') AS has, regexp_matches(x, '(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://') AS owned, regexp_replace(x, '(?s)^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?', '') AS rest FROM e),
p AS (SELECT event_id, x, CASE WHEN owned THEN lower(split_part(rest, '/', 1)) ELSE '' END AS authority, CASE WHEN owned THEN regexp_replace(rest, '^[^/]*/?', '') WHEN has THEN regexp_replace(rest, '^/+', '') ELSE x END AS path FROM s),
q AS (SELECT event_id, x, authority, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')) AS parts FROM p),
k AS (SELECT event_id, x, authority, list_reduce(list_transform(list_prepend(NULL, parts), lambda s: CASE WHEN s IS NULL THEN [] ELSE [s] END), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, s) END) AS parts FROM q)
SELECT event_id, CASE WHEN x = '' THEN '{{null-source}}' ELSE array_to_string(list_concat(CASE WHEN authority <> '' THEN [authority] ELSE [] END, list_transform(parts, lambda g: {_collapsed('g')})), '/') END AS path FROM k"""
_NAVIGABLE = "CASE WHEN contains(x, '://') THEN x ELSE 'https://' || x END"
_WORD = "regexp_extract(trim(x), '^\\S+')"
_TAGS = """WITH e AS (SELECT event_id, """ + dealt(NAMES) + """ AS x FROM events),
w AS (SELECT event_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[_\\-\\s.]+'), lambda t: t <> ''), lambda t: lower(t)) AS t FROM e)
SELECT event_id, array_to_string(list_filter([CASE WHEN list_has_any(t, {ADMIN}) THEN 'admin' END, CASE WHEN list_has_any(t, {AUTH}) OR (list_contains(t, 'api') AND list_contains(t, 'key')) OR (list_contains(t, 'token') AND NOT list_has_any(t, {CURSOR})) OR (list_contains(t, 'session') AND NOT list_contains(t, 'storage')) THEN 'auth' END, CASE WHEN list_has_any(t, {FLAG}) THEN 'flag' END, CASE WHEN list_has_any(t, {IDOR}) THEN 'idor' END], lambda g: g IS NOT NULL), ',') AS tags FROM w"""
for _name in ("ADMIN", "AUTH", "CURSOR", "FLAG", "IDOR"):
    _TAGS = _TAGS.replace("{" + _name + "}", str(getattr(labels, _name)))
_AT = "list_position(" + str(list(labels.STAGES)) + ", CASE WHEN x IN ('paused', 'done', 'partial', 'failed', 'cancelled') THEN stage ELSE x END)"
_OWN = "CASE WHEN x = 'paused' THEN 'paused' WHEN x IN ('done', 'partial', 'failed', 'cancelled') THEN 'stopped' ELSE 'active' END"
_NODES = f"WITH e AS (SELECT event_id, {dealt(STATES)} AS x, CASE WHEN user_id % 4 > 0 THEN {dealt(list(labels.STAGES), 'user_id')} END AS stage FROM events), a AS (SELECT event_id, x, coalesce({_AT}, 0) AS i FROM e) SELECT event_id, array_to_string(list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN x = 'done' THEN 'complete' WHEN x = 'queued' OR i = 0 OR i < k THEN 'pending' WHEN i = k THEN {_OWN} ELSE 'complete' END), ',') AS nodes FROM a"
_FAILURE = f"""WITH e AS (SELECT {dealt(MESSAGES)} AS x FROM events),
m AS (SELECT x, TRY_CAST(nullif(regexp_extract(x, 'HTTP ([0-9]{{3}})', 1), '') AS INTEGER) AS status, nullif(regexp_extract(x, 'not in engagement scope: (\\S+)', 1), '') AS scope, coalesce(nullif(regexp_extract(x, 'DNS resolution failed for (\\S+)', 1), ''), nullif(regexp_extract(x, 'no addresses resolved for (\\S+)', 1), '')) AS dns FROM e)
SELECT CASE WHEN status IN (401, 403) THEN 'access_denied' WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 500 AND 599 THEN 'server_error' WHEN status IS NOT NULL THEN 'http_error' WHEN scope IS NOT NULL THEN 'out_of_scope' WHEN dns IS NOT NULL THEN 'dns_error' WHEN contains(x, 'non-public address') THEN 'blocked_address' WHEN contains(x, 'not authorized for') THEN 'not_authorized' WHEN contains(x, 'malformed URL') OR contains(x, 'scheme not allowed') OR contains(x, 'userinfo is not allowed') OR contains(x, 'missing host') THEN 'invalid_target' WHEN contains(x, 'deadline exceeded') OR contains(x, 'timed out') THEN 'timeout' WHEN contains(x, 'exceeds') AND contains(x, 'bytes') THEN 'too_large' ELSE 'unknown' END AS category,
CASE WHEN status IS NOT NULL THEN NULL WHEN scope IS NOT NULL THEN CASE WHEN NOT (regexp_matches(scope, {_IPV4}) OR contains(scope, ':')) OR {_PUBLIC.replace('@', 'scope')} THEN scope END ELSE dns END AS host, status, count(*) AS n FROM m GROUP BY ALL"""
_PATH = f"regexp_extract(x, {sql.URL}, 3)"
_CLASS = f"CASE WHEN regexp_matches({sql.host('x')}, '(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in labels.TRACKERS) + f")$') OR regexp_matches(string_split(lower({_PATH}), '/')[-1], '{labels.TRACKER_FILE}') THEN 'tracker' WHEN regexp_matches(lower({_PATH}), '{labels.CMS_PATH}') THEN 'cms' WHEN regexp_matches(lower({_PATH}), '{labels.LIBRARY}') THEN 'lib' ELSE 'app' END"
_FOLDER = f"regexp_replace(regexp_extract(url, {sql.URL}, 3), '[^/]*$', '')"
_ROOT = f"regexp_extract(url, {sql.URL}, 1) || '://' || regexp_extract(url, {sql.URL}, 2)"


def _joined(path: str) -> str:
    return f"{_ROOT} || '/' || array_to_string(list_reduce(list_transform(list_prepend(NULL, string_split({path}, '/')[2:]), lambda s: CASE WHEN s IS NULL THEN [] ELSE [s] END), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:len(a) - 1] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END), '/')"


QUERIES = {
    "b02_lanes": (b02_lanes, f"WITH {L}, k AS (SELECT {sql.host('url')} AS host, {dealt(['endpoint', 'endpoint_generic', 'endpoint_unresolved', 'page_route', 'secret'], 'ordinal')} AS kind FROM links) SELECT host, CASE kind WHEN 'endpoint' THEN 'confirmed' WHEN 'page_route' THEN 'route' ELSE 'unconfirmed' END AS lane, count(*) AS n FROM k WHERE kind <> 'secret' GROUP BY ALL"),
    "b08_public_address": (b08_public_address, f"WITH e AS (SELECT event_id, {dealt(ADDRESSES)} AS x FROM events), q AS (SELECT event_id, regexp_replace(lower(x), '^::ffff:', '') AS p FROM e), r AS (SELECT event_id, p, {_NUMBER} AS n FROM q) SELECT event_id, coalesce(regexp_matches(p, {_IPV4}) AND NOT ({_BLOCKS}), false) AS public FROM r"),
    "b10_kept_headers": (b10_kept_headers, "SELECT event_id, 'server,www-authenticate,x-fastly-debug' AS names, 'Negotiate' AS scheme, CAST(least(length(event_type) * 4000, 16384) AS BIGINT) AS n_debug FROM events"),
    "b11_cookie_names": (b11_cookie_names, "SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'sid', 'a' || CAST(event_id % 3 AS VARCHAR)])), ',') AS names FROM events"),
    "b20_asset_class": (b20_asset_class, _one_sql(ASSETS, "class", _CLASS)),
    "b22_script_like": (b22_script_like, _one_sql(ASSETS, "script", f"regexp_matches(lower({_PATH}), '{labels.SCRIPT_PATH}') OR contains(lower(regexp_extract(x, {sql.URL}, 4)), '.js')")),
    "b27_display_source": (b27_display_source, f"SELECT event_id, coalesce(CASE WHEN event_id % 3 = 1 THEN 'src/a.js' END, CASE WHEN event_id % 5 < 2 THEN {dealt(ASSETS)} END, CASE WHEN event_id % 3 = 0 THEN 'input.js' END, CASE WHEN event_id % 2 = 0 THEN 'h.example' END, '?') AS source FROM events"),
    "g08_param_value": (g08_param_value, f"WITH {E}, k AS (SELECT page_id, operation, unnest(string_split(keys, '&')) AS name FROM ep WHERE keys <> '') SELECT page_id, operation || ' query:' || name AS value, NOT contains(name, ' ') AS inverse FROM k"),
    "g10_secret_value": (g10_secret_value, f"WITH {_RULES} SELECT event_id, {_PROVIDER} || ':' || sha256(event_type || '=-x') AS value FROM e"),
    "g11_provider": (g11_provider, f"WITH {_RULES} SELECT event_id, {_PROVIDER} AS provider FROM e"),
    "g12_source_path": (g12_source_path, _SOURCE),
    "g13_collapsed_name": (g13_collapsed_name, f"WITH e AS (SELECT event_id, 'app.' || left(sha256(CAST(event_id AS VARCHAR)), 9) || '-' || event_type || '.js' AS name FROM events) SELECT event_id, {_collapsed('name')} AS name FROM e"),
    "g15_occurrence_hash": (g15_occurrence_hash, "WITH e AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 4 > 0 THEN CAST(event_id AS VARCHAR) ELSE 'null' END AS a, CASE WHEN event_id % 4 > 0 THEN CAST(event_id + 5 AS VARCHAR) ELSE 'null' END AS b FROM events) SELECT event_id, sha256('{\"host\":null,\"kind\":\"' || event_type || '\",\"offset_end\":' || b || ',\"offset_start\":' || a || ',\"run_id\":\"' || CAST(user_id AS VARCHAR) || '\"}') AS occurrence_hash FROM e"),
    "g18_attributed_host": (g18_attributed_host, f"WITH e AS (SELECT event_id, {dealt(TARGETS)} AS x FROM events), u AS (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'https://EXPR.example.com/x' ELSE {_NAVIGABLE} END AS url FROM e) SELECT event_id, CASE WHEN lower(regexp_extract(url, {sql.URL}, 1)) IN ('http', 'https') AND NOT contains(regexp_extract(url, {sql.URL}, 2), 'EXPR') AND regexp_matches({sql.host('url')}, '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$') AND NOT regexp_matches({sql.host('url')}, '(^|\\.)[0-9]+$') THEN {sql.host('url')} END AS host FROM u"),
    "g19_target_host": (g19_target_host, f"WITH e AS (SELECT event_id, {dealt(TARGETS)} AS x FROM events), u AS (SELECT event_id, CASE WHEN contains({_WORD}, '://') THEN {_WORD} ELSE 'https://' || {_WORD} END AS url FROM e) SELECT event_id, {sql.host('url')} AS host FROM u"),
    "g21_resolve_reference": (g21_resolve_reference, f"WITH p AS (SELECT page_id, url, {dealt(REFS, 'page_id')} AS ref, CASE WHEN {_FOLDER} = '' THEN '/' ELSE {_FOLDER} END AS folder FROM pages WHERE url IS NOT NULL) SELECT page_id, CASE WHEN starts_with(ref, '//') THEN regexp_extract(url, {sql.URL}, 1) || ':' || ref WHEN regexp_matches(ref, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN ref WHEN starts_with(ref, '/') THEN {_joined('ref')} WHEN starts_with(ref, '.') THEN {_joined('folder || ref')} END AS resolved FROM p"),
    "g28_minified_by_shape": (g28_minified_by_shape, "SELECT doc_id, coalesce(length(text) > 0 AND (length(text) / len(string_split(text, chr(10))) > 500 OR (length(text) - length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))) / length(text) < 0.1), false) AS minified FROM documents"),
    "g31_stalled": (g31_stalled, "WITH e AS (SELECT event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS now FROM events) SELECT event_id, event_type <> 'purchase' AND epoch_us(coalesce(now, ts)) - epoch_us(ts) > 3600000000 AS stalled FROM e"),
    "g33_retryable": (g33_retryable, "SELECT event_id, 395 + event_id % 220 = 429 OR 395 + event_id % 220 BETWEEN 500 AND 599 AS again FROM events"),
    "g34_failure": (g34_failure, _FAILURE),
    "g35_clamped": (g35_clamped, "SELECT event_id, CAST(least(CASE WHEN event_id % 7 > 0 AND event_id % 90 - 10 > 0 THEN event_id % 90 - 10 ELSE 20 END, 60) AS BIGINT) AS bytes FROM events"),
    "g39_risk_tags": (g39_risk_tags, _TAGS),
    "g40_callee": (g40_callee, _one_sql(CALLEES, "valid", "regexp_matches(x, '^[A-Za-z_$][A-Za-z0-9_$]*(\\.[A-Za-z_$][A-Za-z0-9_$]*)*$')")),
    "g41_base_url": (g41_base_url, f"WITH e AS (SELECT event_id, {dealt(BASES)} AS x FROM events), u AS (SELECT event_id, x, lower(regexp_extract(x, {sql.URL}, 1)) AS s, regexp_extract(x, {sql.URL}, 2) AS a, regexp_extract(x, {sql.URL}, 4) || regexp_extract(x, {sql.URL}, 5) AS q FROM e) SELECT event_id, x <> '' AND q = '' AND CASE WHEN s <> '' OR a <> '' THEN s IN ('http', 'https') AND a <> '' AND NOT contains(a, '@') ELSE starts_with(x, '/') END AS valid FROM u"),
    "g42_node_statuses": (g42_node_statuses, _NODES),
    "g43_source_map_error": (g43_source_map_error, _one_sql(PROBLEMS, "class", "CASE WHEN contains(lower(x), 'http 404') THEN 'not_found' WHEN contains(lower(x), 'http 401') OR contains(lower(x), 'http 403') THEN 'forbidden' ELSE 'fetch_failed' END")),
    "g44_bare_domain": (g44_bare_domain, _one_sql(TARGETS, "bare", f"regexp_extract({_NAVIGABLE}, {sql.URL}, 3) IN ('', '/')")),
    "g45_type_label": (g45_type_label, _one_sql(["endpoint", "endpoint_generic", "endpoint_unresolved", "page_route", "secret"], "label", "CASE x WHEN 'endpoint' THEN 'API' WHEN 'endpoint_unresolved' THEN 'unconfirmed' WHEN 'endpoint_generic' THEN 'generic call' WHEN 'page_route' THEN 'page route' ELSE x END")),
    "g46_relative_time": (g46_relative_time, "WITH e AS (SELECT event_id, CASE WHEN event_id % 6 > 0 THEN 1 END AS there, floor(CAST(pow(1.7, event_id % 28) AS DECIMAL(18, 6)) + 0.5) AS s FROM events), m AS (SELECT *, floor(s / 60 + 0.5) AS m FROM e), h AS (SELECT *, floor(m / 60 + 0.5) AS h FROM m) SELECT event_id, CASE WHEN there IS NULL THEN '—' WHEN s < 60 THEN 'just now' WHEN m < 60 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) || 'm ago' WHEN h < 24 THEN CAST(CAST(h AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(h / 24 + 0.5) AS BIGINT) AS VARCHAR) || 'd ago' END AS ago FROM h"),
    "g47_navigable_url": (g47_navigable_url, _one_sql(TARGETS, "url", _NAVIGABLE)),
    "e11_card_label": (e11_card_label, "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(event_id AS VARCHAR) END, CASE WHEN event_id % 5 = 0 THEN 't.example' END, CASE WHEN event_id % 7 = 0 THEN 'a.example' END, CASE WHEN event_id % 2 = 0 THEN 's.example' END, '—') AS label FROM events"),
    "m14_sse_frames": (m14_sse_frames, "WITH e AS (SELECT event_id, event_id % 5 AS k FROM events WHERE event_id % 5 NOT IN (0, 3)) SELECT event_id, CASE k WHEN 1 THEN '7' ELSE '' END AS id, CASE k WHEN 1 THEN 'run.transition' WHEN 2 THEN 'job.progress' ELSE 'message' END AS event, CASE k WHEN 1 THEN '{\"to\":\"done\"}' WHEN 2 THEN '{\"done\":3}' ELSE 'x' END AS data, k = 1 AS ends FROM e"),
}
