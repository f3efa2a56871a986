"""Classes, verdicts and display labels of single values, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basalt.functions import urls

# Words of parameter names by risk, and the words that make a token a cursor.
AUTH = "auth authorization authentication jwt bearer secret credential credentials otp mfa password passwd passphrase apikey sessionid".split()
CURSOR = "next page prev previous cursor continuation offset".split()
ADMIN = "admin administrator superuser sudo privileged impersonate".split()
IDOR = "id uuid guid".split()
FLAG = "flag feature toggle enabled disabled beta experimental".split()
NAME_CUT = "[_\\-\\s.]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# Hosts of trackers, and patterns of file names by class of asset.
TRACKERS = "google-analytics.com googletagmanager.com doubleclick.net segment.io segment.com mixpanel.com hotjar.com facebook.net fbcdn.net amplitude.com sentry.io clarity.ms newrelic.com optimizely.com".split()
TRACKER_FILE = "\\b(gtag|analytics|gtm|fbevents|hotjar)\\b"
CMS_PATH = "/wp-content/|/wp-includes/|\\bwp-"
LIBRARY = "jquery[.-]|\\breact(-dom)?[.-]|\\bvue[.-]|angular[.-]|lodash|bootstrap|\\bd3[.-]|moment|polyfill|\\bvendors?[~.-]|runtime~|\\.min\\.js(\\?|$)"
SCRIPT_PATH = "\\.(js|mjs|cjs|jsx)$|/chunk|/bundle"

# Stages in order, states, and labels of finding types.
STAGES = ("discovering", "fetching", "ingesting", "analyzing", "correlating")
TERMINAL = ("done", "partial", "failed", "cancelled")
TYPE_LABELS = {"endpoint": "API", "endpoint_unresolved": "unconfirmed", "endpoint_generic": "generic call", "page_route": "page route"}

# Response headers that are kept, by name and by prefix, and the most characters of a value.
HEADERS = "server x-powered-by x-aspnet-version x-aspnetmvc-version x-generator x-drupal-dynamic-cache x-drupal-cache via x-varnish cf-ray x-amz-cf-id x-served-by x-shopify-stage x-github-request-id content-security-policy content-security-policy-report-only www-authenticate powered powered-by x-powered-cms platform x-cdn x-servedby x-turbo-charged-by x-litespeed-cache x-cache alt-svc vary".split()
HEADER_PREFIX = "^(x-fastly-|access-control-allow-)"
HEADER_CHARS = 16384

#: Not-public IPv4 ranges as (first, last) of whole addresses, from the registries of special-purpose and multicast addresses.
NOT_PUBLIC = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")
IPV4 = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def risk_tags(name: Column) -> Column:
    """Sorted tags (admin, auth, flag, idor) that the whole words of a parameter's name earn."""
    words = F.transform(F.filter(F.split(F.coalesce(name, F.lit("")), NAME_CUT), lambda w: w != ""), F.lower)

    def any_of(group: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*map(F.lit, group)))

    def has(word: str) -> Column:
        return F.array_contains(words, word)

    auth = any_of(AUTH) | (has("api") & has("key")) | (has("token") & ~any_of(CURSOR)) | (has("session") & ~has("storage"))
    return F.array_compact(F.array(F.when(any_of(ADMIN), "admin"), F.when(auth, "auth"), F.when(any_of(FLAG), "flag"), F.when(any_of(IDOR), "idor")))


def asset_class(url: Column) -> Column:
    """tracker, cms, lib or app: the first that fits."""
    host, path = urls.host(url), F.lower(urls.part(url, urls.PATH))
    last = F.element_at(F.split(path, "/"), -1)
    tracker = host.rlike("(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in TRACKERS) + ")$") | last.rlike(TRACKER_FILE)
    return F.when(tracker, "tracker").when(path.rlike(CMS_PATH), "cms").when(path.rlike(LIBRARY), "lib").otherwise("app")


def script_like(url: Column) -> Column:
    return F.coalesce(F.lower(urls.part(url, urls.PATH)).rlike(SCRIPT_PATH) | F.contains(F.lower(urls.part(url, urls.QUERY)), F.lit(".js")), F.lit(False))


def minified_by_shape(source: Column) -> Column:
    """The viewer's rule: over 500 characters a line on average, or under a tenth white space."""
    spaces = F.length(source) - F.length(F.regexp_replace(source, "\\s", ""))
    lines = F.size(F.split(source, "\n"))
    return F.coalesce((F.length(source) > 0) & ((F.length(source) / lines > 500) | (spaces / F.length(source) < 0.1)), F.lit(False))


def stalled(active: Column, beat: Column, now: Column, seconds: int = 30) -> Column:
    """Whether an active run's last beat is more than so many seconds ago."""
    return active & (F.timestamp_diff("MICROSECOND", beat, now) > seconds * 1_000_000)


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def clamped(wanted: Column, default: int, ceiling: int) -> Column:
    """The wanted number if it is positive, else the default; the ceiling at most."""
    return F.least(F.when(wanted > 0, wanted).otherwise(F.lit(default)), F.lit(ceiling))


def public_ipv4(address: Column) -> Column:
    """Whether a literal IPv4 address (plain, or mapped into IPv6) may be reached from anywhere; false for anything else."""
    plain = F.regexp_replace(F.lower(address), "^::ffff:", "")
    parts = F.split(plain, "\\.")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    out = plain.rlike(IPV4)
    for block in NOT_PUBLIC:
        base, bits = block.split("/")
        first = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        out = out & ~number.between(first, first + (1 << (32 - int(bits))) - 1)
    return F.coalesce(out, F.lit(False))


def failure(message: Column) -> Column:
    """struct(category, host, status) of a failure's message; a host that is an address nobody may reach is not named."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))

    status, scope = found("HTTP ([0-9]{3})").cast("int"), found("not in engagement scope: (\\S+)")
    dns = F.coalesce(found("DNS resolution failed for (\\S+)"), found("no addresses resolved for (\\S+)"))

    def says(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(message, F.lit(p))
        return out

    by_status = F.when(status.isin(401, 403), "access_denied").when(status == 429, "rate_limited").when(status.between(500, 599), "server_error").otherwise("http_error")
    category = (
        F.when(status.isNotNull(), by_status)
        .when(scope.isNotNull(), "out_of_scope")
        .when(dns.isNotNull(), "dns_error")
        .when(says("non-public address"), "blocked_address")
        .when(says("not authorized for"), "not_authorized")
        .when(says("malformed URL", "scheme not allowed", "userinfo is not allowed", "missing host"), "invalid_target")
        .when(says("deadline exceeded", "timed out"), "timeout")
        .when(says("exceeds") & says("bytes"), "too_large")
        .otherwise("unknown")
    )
    literal = scope.rlike(IPV4) | F.contains(scope, F.lit(":"))
    named = F.when(status.isNotNull(), F.lit(None)).when(scope.isNotNull(), F.when(~literal | public_ipv4(scope), scope)).otherwise(dns)
    return F.struct(category.alias("category"), named.alias("host"), status.alias("status"))


def kept_headers(headers: Column) -> Column:
    """The headers of the list, values cut; of an authentication challenge the scheme alone. Keys are lower-cased already."""
    kept = F.map_filter(headers, lambda k, v: k.isin(*HEADERS) | k.rlike(HEADER_PREFIX))
    return F.transform_values(kept, lambda k, v: F.left(F.when(k == "www-authenticate", F.element_at(F.split(F.trim(v), "\\s+"), 1)).otherwise(v), F.lit(HEADER_CHARS)))


def cookie_names(lines: Column) -> Column:
    """Sorted names of Set-Cookie lines; values are dropped."""
    named = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("="))), lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1))))
    return F.array_sort(F.array_distinct(F.filter(named, lambda n: n != "")))


def callee_valid(callee: Column) -> Column:
    name = "[A-Za-z_$][A-Za-z0-9_$]*"
    return F.coalesce(callee.rlike(f"^{name}(\\.{name})*$"), F.lit(False))


def base_url_valid(url: Column) -> Column:
    """A path from the root or an http(s) URL with a host; no query, fragment or user."""
    scheme, authority = F.lower(urls.part(url, urls.SCHEME)), urls.part(url, urls.AUTHORITY)
    bare = (urls.part(url, urls.QUERY) == "") & (urls.part(url, urls.FRAGMENT) == "")
    whole = scheme.isin("http", "https") & (authority != "") & ~F.contains(authority, F.lit("@"))
    return F.coalesce((url != "") & bare & F.when((scheme != "") | (authority != ""), whole).otherwise(F.startswith(url, F.lit("/"))), F.lit(False))


def node_statuses(state: Column, stage: Column) -> Column:
    """For each stage of the pipeline complete, active, paused, stopped or pending."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.when(state.isin("paused", *TERMINAL), stage).otherwise(state))
    own = F.when(state == "paused", "paused").when(state.isin(*TERMINAL), "stopped").otherwise("active")

    def one(k: int) -> Column:
        return F.when(state == "done", "complete").when((state == "queued") | (F.coalesce(at, F.lit(0)) == 0) | (at < k), "pending").when(at == k, own).otherwise("complete")

    return F.array(*(one(k + 1) for k in range(len(STAGES))))


def source_map_error(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(F.contains(text, F.lit("http 404")), "not_found").when(F.contains(text, F.lit("http 401")) | F.contains(text, F.lit("http 403")), "forbidden").otherwise("fetch_failed")


def type_label(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in TYPE_LABELS.items() for x in item)), kind), kind)


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in whole minutes, hours or days, each rounded half up from the unit below."""
    seconds = F.greatest(F.floor(F.timestamp_diff("MICROSECOND", then, now) / 1_000_000 + 0.5), F.lit(0))
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return F.when(then.isNull(), "\u2014").when(seconds < 60, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).otherwise(ago(days, "d"))


def card_label(name: Column, external: Column, target_host: Column, asset_host: Column, scope: Column) -> Column:
    """A name that is not the external id, else the first host known, else a dash."""
    own = F.trim(F.coalesce(name, F.lit("")))
    own = F.when(F.coalesce(own == F.trim(external), F.lit(False)), "").otherwise(own)
    empty = F.lit("")
    return F.coalesce(F.nullif(own, empty), F.nullif(target_host, empty), F.nullif(asset_host, empty), F.try_element_at(scope, F.lit(1)), F.lit("\u2014"))


def occurrence_source(path: Column, asset_url: Column, host: Column) -> Column:
    """Where a sighting is shown: a recovered path, else the asset, else what is left."""
    return F.coalesce(F.nullif(path, F.lit("input.js")), asset_url, path, host, F.lit("?"))
