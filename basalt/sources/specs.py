"""API descriptions (OpenAPI 3 and Swagger 2, as JSON or YAML) as tables of documented operations.

Each body is parsed once, in a task, within bounds of size, nodes and depth; what leaves the task is one row with
the body as plain JSON and its local references. Everything else is done on tables: chains of references are
followed by a recursive query, bases and operations are taken out of the JSON by Spark's own functions. A body
that fails is a row with its reason; it never stops the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import urls

MOST_BYTES, MOST_NODES, MOST_DEPTH = 5 * 1024 * 1024, 200_000, 100
#: The keys of a path item that are operations.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
OPENAPI, SWAGGER = "openapi-3", "swagger-2"
LOOKED_AT = "format string, problem string, flaw string, nodes long, depth int, text string, refs array<struct<at: string, target: string>>"
#: A chain of references from each start; it stops where it has been before, or after MOST_DEPTH steps.
CHAINS = f"""
WITH RECURSIVE chain(spec_id, at, seen) MAX RECURSION LEVEL {MOST_DEPTH + 1} AS (
  SELECT spec_id, target, array(at) FROM {{refs}}
  UNION ALL
  SELECT c.spec_id, r.target, array_append(c.seen, c.at) FROM chain c JOIN {{refs}} r ON r.spec_id <=> c.spec_id AND r.at = c.at
  WHERE NOT array_contains(c.seen, c.at) AND size(c.seen) < {MOST_DEPTH})
SELECT DISTINCT spec_id FROM chain WHERE array_contains(seen, at) OR size(seen) = {MOST_DEPTH}"""


class Rejected(ValueError):
    """Why a body is no usable description."""


def _loaded(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        raise Rejected("too deep") from None
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:  # then JSON alone is read
        raise Rejected("not JSON") from None
    try:
        # an anchor can make a small body grow without bound, and no description needs one
        if any(getattr(event, "anchor", None) for event in yaml.parse(text)):
            raise Rejected("YAML anchor")
        return yaml.safe_load(text)
    except yaml.YAMLError:
        raise Rejected("not JSON or YAML") from None
    except RecursionError:
        raise Rejected("too deep") from None


def _step(name: object) -> str:
    return str(name).replace("~", "~0").replace("/", "~1")


def _found(doc: object, pointer: str) -> bool:
    """Whether a local pointer leads to something."""
    for step in pointer[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(doc, list) and step.isdigit() and int(step) < len(doc):
            doc = doc[int(step)]
        elif isinstance(doc, dict) and step in doc:
            doc = doc[step]
        else:
            return False
    return True


def _looked_at(body: str | None) -> dict[str, object]:
    out: dict[str, object] = {"nodes": 0, "depth": 0, "refs": []}
    try:
        if body is None:
            raise Rejected("too large")
        doc = _loaded(body)
        if not isinstance(doc, dict):
            raise Rejected("not an object")
        open_: list[tuple[str, object, int]] = [("#", doc, 1)]
        while open_:
            at, node, depth = open_.pop()
            out["nodes"], out["depth"] = out["nodes"] + 1, max(out["depth"], depth)
            if out["nodes"] > MOST_NODES:
                raise Rejected("too many nodes")
            if depth > MOST_DEPTH:
                raise Rejected("too deep")
            if isinstance(node, dict):
                if "$ref" in node:
                    out["refs"].append({"at": at, "target": node["$ref"]})
                open_ += [(f"{at}/{_step(k)}", v, depth + 1) for k, v in node.items()]
            elif isinstance(node, list):
                open_ += [(f"{at}/{k}", v, depth + 1) for k, v in enumerate(node)]
        if any(not isinstance(r["target"], str) or not r["target"].startswith("#") for r in out["refs"]):
            raise Rejected("external $ref")
        if not all(_found(doc, r["target"]) for r in out["refs"]):
            raise Rejected("unresolved $ref")
        out["format"] = OPENAPI if "openapi" in doc else SWAGGER if doc.get("swagger") == "2.0" else None
        info = doc.get("info")
        if out["format"] is None:
            out["flaw"] = "unrecognized"
        elif not isinstance(info, dict) or not all(isinstance(info.get(k), str) for k in ("title", "version")):
            out["flaw"] = "no title or version"
        elif not isinstance(doc.get("paths"), dict) and not (out["format"] == OPENAPI and "paths" not in doc and str(doc["openapi"]).startswith("3.1")):
            out["flaw"] = "no paths"
        out["text"] = json.dumps(doc, default=str)
    except Rejected as why:
        out["problem"], out["refs"] = str(why), []
    return out


def looked_at(specs: DataFrame, spec_id: str = "spec_id", body: str = "body") -> DataFrame:
    """spec_id, format, problem, flaw, nodes, depth, text, refs of every body."""
    small = F.when(F.octet_length(body) <= MOST_BYTES, F.col(body).cast("string"))
    rows = specs.select(F.col(spec_id).alias("spec_id"), F.coalesce(small, F.when(F.col(body).isNull(), "")).alias("body"))
    refs = pa.list_(pa.struct([("at", pa.string()), ("target", pa.string())]))
    kinds = {"format": pa.string(), "problem": pa.string(), "flaw": pa.string(), "nodes": pa.int64(), "depth": pa.int32(), "text": pa.string(), "refs": refs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 16):  # a few bodies at a time
                some = batch.slice(a, 16)
                found = [_looked_at(x) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([f.get(n) for f in found], t) for n, t in kinds.items())], ["spec_id", *kinds])

    return rows.mapInArrow(run, f"spec_id {rows.schema['spec_id'].dataType.simpleString()}, {LOOKED_AT}")


def circular(looked: DataFrame) -> DataFrame:
    """spec_id of the descriptions with a chain of references that never ends (or is longer than MOST_DEPTH).

    Only references that lead to another reference take part, so the recursive query sees few rows; beyond
    spark.sql.cteRecursionRowLimit of them it stops with an error.
    """
    refs = looked.where("problem IS NULL").select("spec_id", F.explode("refs").alias("r")).select("spec_id", "r.at", "r.target")
    starts = refs.select(F.col("spec_id").alias("i"), F.col("at").alias("a"))
    chained = refs.join(starts, F.col("spec_id").eqNullSafe(F.col("i")) & (F.col("target") == F.col("a")), "left_semi")
    return refs.sparkSession.sql(CHAINS, refs=chained)


def verdicts(looked: DataFrame) -> DataFrame:
    """spec_id, format, reason (null: accepted), nodes, depth, text."""
    loops = circular(looked).select(F.col("spec_id").alias("i"), F.lit("circular $ref").alias("loop"))
    both = looked.join(loops, F.col("spec_id").eqNullSafe(F.col("i")), "left")
    return both.select("spec_id", "format", F.coalesce("problem", "loop", "flaw").alias("reason"), "nodes", "depth", "text")


def server_bases(text: Column, kind: Column) -> Column:
    """The path part of every server, its variables replaced by their defaults; without servers one empty base."""
    servers = F.from_json(F.get_json_object(text, "$.servers"), "array<struct<url: string, variables: map<string, struct<default: string>>>>")
    filled = lambda s: F.aggregate(F.coalesce(F.map_entries(s.variables), F.array().cast("array<struct<key: string, value: struct<default: string>>>")), F.coalesce(s.url, F.lit("")), lambda url, e: F.coalesce(F.replace(url, F.concat(F.lit("{"), e.key, F.lit("}")), e.value["default"]), url))
    paths = F.transform(servers, lambda s: F.coalesce(urls.part(filled(s), urls.PATH), F.lit("")))
    of_servers = F.when(F.coalesce(F.size(servers), F.lit(0)) > 0, paths).otherwise(F.array(F.lit("")))
    return F.when(kind == SWAGGER, F.array(F.coalesce(F.get_json_object(text, "$.basePath"), F.lit("")))).otherwise(of_servers)


def documented(judged: DataFrame) -> DataFrame:
    """spec_id, ord (path, method and base in the order of the document), method, path, operation of accepted descriptions."""
    accepted = judged.where("reason IS NULL").select("spec_id", server_bases(F.col("text"), F.col("format")).alias("bases"), F.from_json(F.get_json_object("text", "$.paths"), "map<string, string>").alias("paths"))
    items = accepted.select("spec_id", "bases", F.posexplode("paths").alias("p", "path", "item"))
    methods = items.select("spec_id", "bases", "p", "path", F.posexplode(F.map_keys(F.from_json("item", "map<string, string>"))).alias("m", "method")).where(F.col("method").isin(*METHODS))
    each = methods.select("spec_id", "p", "m", F.upper("method").alias("method"), "path", F.posexplode("bases").alias("b", "base"))
    path = F.concat("base", "path")
    return each.select("spec_id", F.struct("p", "m", "b").alias("ord"), "method", path.alias("path"), F.concat("method", F.lit(" "), path).alias("operation"))
