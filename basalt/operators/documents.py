"""One OpenAPI document for each run out of the requests that were seen in it.

Requests whose paths become one path with one method are one operation. What they bring is folded key by key:
parameters by name and place, of equal ones the first counts; names of bodies, media types, risk tags and
security schemes are united. Each fold is an aggregate over rows of one operation's parts, so no list of requests
is collected; operations become JSON texts, then path items, then one document a run.

requests: run, ord, method, path, hosts (array), query (array of name, example), body (array), content_type,
example_url, probeable, auth (array of name, scheme). Types and schemas are inferred, and the document says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import labels
from basalt.operators import correlate
from basalt.sources.specs import METHODS

PREFIX = "x-basalt"
#: What the document says of its own limits.
INFERRED = "Name seen; type inferred."
SYNTHETIC = "Named after its place in the path; the type is inferred."
BODY = "Names seen in calls; types inferred; there may be more."
RESPONSE = "Responses were not seen."
SERVER = "Host seen; scheme and port inferred where no whole URL was seen."
OPERATION = ["run", "path", "method"]


def _with(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key is a key like others."""
    b = b.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return a.join(b, same, "left").drop(*(f"_{k}" for k in keys))


def standard(requests: DataFrame) -> DataFrame:
    """Requests that can stand under a path, with `path` as in the document, `raw` as it was, and the method in small letters."""
    verb = F.lower("method")
    rows = requests.where(F.col("probeable") & verb.isin(*METHODS))
    return rows.withColumns({"raw": F.col("path"), "path": correlate.canonical_path(F.col("path")), "method": verb})


def _path_parameters(raw: Column, path: Column) -> Column:
    """array(name, kind) of the segments that became parameters."""
    pairs = F.zip_with(F.split(raw, "/"), F.split(path, "/"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    open_ = F.filter(pairs, lambda p: p["b"].rlike("^\\{.*\\}$"))
    kind = lambda p: F.when(p["a"] == "{id}", "integer").when(p["a"] == "{uuid}", "uuid").otherwise("string")
    return F.transform(open_, lambda p: F.struct(F.substring(p["b"], F.lit(2), F.length(p["b"]) - 2).alias("name"), kind(p).alias("kind")))


def parameters(rows: DataFrame) -> DataFrame:
    """One row for each parameter of an operation: name, place, kind, example of the first request that has it, and its order."""
    path = F.transform(_path_parameters(F.col("raw"), F.col("path")), lambda p, k: F.struct(F.lit(0).alias("group"), k.alias("k"), p["name"].alias("name"), F.lit("path").alias("place"), p["kind"].alias("kind"), F.lit(None).cast("string").alias("example")))
    query = F.transform("query", lambda p, k: F.struct(F.lit(1).alias("group"), k.alias("k"), p["name"].alias("name"), F.lit("query").alias("place"), F.lit("string").alias("kind"), p["example"].alias("example")))
    each = rows.select(*OPERATION, "ord", F.explode(F.concat(path, F.coalesce(query, F.array().cast(_type(rows, query))))).alias("p"))
    first = F.min(F.struct("ord", "p.group", "p.k", "p.kind", "p.example"))
    return each.groupBy(*OPERATION, "p.name", "p.place").agg(first.alias("first"))


def _type(rows: DataFrame, column: Column) -> str:
    return rows.select(column.alias("x")).schema["x"].dataType.simpleString()


def scheme_key(name: Column, scheme: Column) -> Column:
    known = (F.lower(name) == "authorization") & scheme.isin("bearer", "basic")
    plain = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    return F.when(known, F.concat(scheme, F.lit("Auth"))).otherwise(F.when(plain == "", "auth").otherwise(plain))


def _auth(rows: DataFrame, keys: list[str]) -> DataFrame:
    each = rows.select(*keys, "ord", F.posexplode("auth").alias("k", "a"))
    return each.select(*keys, "ord", "k", scheme_key(F.col("a.name"), F.col("a.scheme")).alias("key"), "a.name", "a.scheme")


def merged(requests: DataFrame) -> DataFrame:
    """One row for each operation: parameters (in order), body_names, media_types, risk, security, and whether several requests met."""
    rows = standard(requests)
    each = rows.groupBy(*OPERATION).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("requests"))
    params = parameters(rows).groupBy(*OPERATION).agg(F.array_sort(F.collect_list(F.struct("first", "name", "place"))).alias("p"))
    params = params.select(*OPERATION, F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["place"].alias("place"), x["first"]["kind"].alias("kind"), x["first"]["example"].alias("example"))).alias("parameters"))
    bodies = rows.select(*OPERATION, "ord", "content_type", F.posexplode("body").alias("k", "name")).groupBy(*OPERATION, "name").agg(F.min(F.struct("ord", "k")).alias("at"), F.collect_set("content_type").alias("types"))
    # a lone request keeps its own order, several are sorted
    bodies = bodies.groupBy(*OPERATION).agg(F.array_sort(F.collect_list(F.struct("at", "name")))["name"].alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("media_types"))
    names = rows.select(*OPERATION, F.explode(F.concat(F.coalesce(F.transform("query", lambda p: p["name"]), F.array().cast("array<string>")), F.coalesce("body", F.array().cast("array<string>")))).alias("name")).distinct()
    risk = names.withColumn("tags", labels.risk_tags(F.col("name"))).where(F.size("tags") > 0).groupBy(*OPERATION).agg(F.array_sort(F.collect_list(F.struct("name", "tags"))).alias("risk"))
    security = _auth(rows, OPERATION).groupBy(*OPERATION).agg(F.array_sort(F.collect_set("key")).alias("security"))
    out = reduce(lambda a, b: _with(a, b, OPERATION), [params, bodies, risk, security], each)
    return out.withColumn("body_names", F.when(F.col("requests") > 1, F.array_sort("names")).otherwise(F.col("names"))).drop("names")


def operation_json(prefix: str = PREFIX) -> Column:
    """The operation object of a row of merged(), as JSON text."""
    kind = lambda p: F.struct(F.when(p["kind"] == "integer", "integer").otherwise("string").alias("type"), F.when(p["kind"] == "uuid", "uuid").alias("format"))
    params = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["place"].alias("in"), (p["place"] == "path").alias("required"), kind(p).alias("schema"), F.when(p["place"] == "path", SYNTHETIC).otherwise(INFERRED).alias("description"), p["example"].alias("example")))
    has, typed = F.coalesce(F.size("body_names"), F.lit(0)) > 0, F.coalesce(F.size("media_types"), F.lit(0)) > 0
    properties = F.map_from_entries(F.transform("body_names", lambda n: F.struct(n, F.struct(F.lit("string").alias("type"), F.lit(INFERRED).alias("description")))))
    media = F.struct(F.struct(F.lit("object").alias("type"), F.lit(BODY).alias("description"), properties.alias("properties")).alias("schema"))
    content = F.map_from_entries(F.transform("media_types", lambda t: F.struct(t, media)))
    body = F.when(has & typed, F.struct(F.lit(False).alias("required"), content.alias("content")))
    synthesized = F.exists(F.coalesce("parameters", F.array().cast("array<struct<name: string, place: string, kind: string, example: string>>")), lambda p: p["place"] == "path")
    sure = F.struct(F.lit("certain").alias("path"), F.lit("observed-only").alias("methods"), F.when(synthesized, "synthesized").otherwise("observed").alias("param-names"), F.lit("inferred").alias("param-types"), F.when(~has, "absent").when(typed, "inferred").otherwise("names-only").alias("body"))
    bare = F.when(has & ~typed, F.col("body_names"))
    security = F.when(F.size("security") > 0, F.array(F.map_from_entries(F.transform("security", lambda k: F.struct(k, F.array().cast("array<string>"))))))
    return F.to_json(
        F.struct(
            sure.alias(f"{prefix}-confidence"),
            F.struct(F.struct(F.lit(RESPONSE).alias("description")).alias("default")).alias("responses"),
            params.alias("parameters"),
            body.alias("requestBody"),
            bare.alias(f"{prefix}-body-params"),
            F.when(bare.isNotNull(), F.concat(F.lit("A body with these names was seen: "), F.array_join("body_names", ", "), F.lit("; its media type was not."))).alias("description"),
            F.map_from_entries("risk").alias(f"{prefix}-risk"),
            security.alias("security"),
        )
    )


def servers(requests: DataFrame) -> DataFrame:
    """run, url: for each host the origin of the last whole URL that was seen of it, else https and its name."""
    origin = "^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)(?::([0-9]+))?"
    part = lambda k: F.regexp_extract("example_url", origin, k)
    seen = requests.where("probeable").select("run", "ord", F.lower(part(2)).alias("host"), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(part(3) != "", F.concat(F.lit(":"), part(3))).otherwise("")).alias("url")).where("host <> ''")
    named = requests.where("probeable").select("run", F.explode("hosts").alias("host")).select("run", F.lit(-1).cast("long").alias("ord"), "host", F.concat(F.lit("https://"), "host").alias("url"))
    return seen.select("run", F.col("ord").cast("long").alias("ord"), F.regexp_replace("host", "^\\[|\\]$", "").alias("host"), "url").unionByName(named).groupBy("run", "host").agg(F.max_by("url", "ord").alias("url")).select("run", "url").distinct()


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.select("run", value.alias("v")).distinct().groupBy("run").agg(F.array_sort(F.collect_list("v")).alias(name))


def documents(requests: DataFrame, prefix: str = PREFIX, graphql: DataFrame | None = None) -> DataFrame:
    """run, document (JSON text) of every run that has requests. graphql: run, kind, name of operations to list."""
    ops = merged(requests).select(*OPERATION, "first", operation_json(prefix).alias("op"))
    items = ops.groupBy("run", "path").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "method", "op"))).alias("o"))
    item = F.concat(_quoted(F.col("path")), F.lit(":{"), F.array_join(F.transform("o", lambda x: F.concat(F.lit('"'), x["method"], F.lit('":'), x["op"])), ","), F.lit("}"))
    paths = items.select("run", "first", item.alias("item"), "path").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("first", "path", "item"))).alias("i"))
    runs = requests.select("run").distinct()
    call = F.concat("method", F.lit(" "), F.coalesce(F.nullif("example_url", F.lit("")), "path"))
    sockets = _listed(requests.where(~F.col("probeable")), call, "sockets")
    others = _listed(requests.where(F.col("probeable") & ~F.lower("method").isin(*METHODS)), call, "others")
    schemes = _auth(standard(requests), ["run"]).groupBy("run", "key").agg(F.min_by(F.struct("name", "scheme"), F.struct("ord", "k")).alias("s"))
    http = F.endswith("key", F.lit("Auth")) & (F.lower("s.name") == "authorization") & F.col("s.scheme").isin("bearer", "basic")
    scheme = F.struct(F.when(http, "http").otherwise("apiKey").alias("type"), F.when(http, F.col("s.scheme")).alias("scheme"), F.when(~http, "header").alias("in"), F.when(~http, F.col("s.name")).alias("name"))
    schemes = schemes.select("run", F.struct("key", scheme.alias("value")).alias("e")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("schemes"))
    places = servers(requests).groupBy("run").agg(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.struct(u.alias("url"), F.lit(SERVER).alias("description"))).alias("servers"))
    queries = graphql if graphql is not None else requests.where(F.lit(False)).select("run", F.lit("").alias("kind"), F.lit("").alias("name"))
    queries = queries.distinct().groupBy("run").agg(F.array_sort(F.collect_list(F.struct("kind", "name"))).alias("queries"))
    out = reduce(lambda a, b: _with(a, b, ["run"]), [paths, sockets, others, schemes, places, queries], runs)
    info = F.struct(F.concat(F.lit("Reconstructed API of run "), F.left(F.coalesce(F.col("run").cast("string"), F.lit("none")), F.lit(8))).alias("title"), F.lit("0.0.0").alias("version"))
    rest = F.to_json(F.struct(F.lit("3.0.3").alias("openapi"), info.alias("info"), F.col("servers"), F.col("sockets").alias(f"{prefix}-websocket-endpoints"), F.col("others").alias(f"{prefix}-other-operations"), F.col("queries").alias(f"{prefix}-graphql-operations"), F.when(F.col("schemes").isNotNull(), F.struct(F.col("schemes").alias("securitySchemes"))).alias("components")))
    body = F.coalesce(F.array_join(F.col("i.item"), ","), F.lit(""))
    return out.select("run", F.concat(F.left(rest, F.length(rest) - 1), F.lit(',"paths":{'), body, F.lit("}}")).alias("document"))
