"""Column builders for what comes in: JSON texts, source-map comments, data URLs, scopes of a capture and import paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comment that names a source map, in line or block form.
MAP_COMMENT = "(?://|/\\*)# sourceMappingURL=([^ \\t\\n*]+)"
_LINE_COMMENT = "//# sourceMappingURL=([^ \\t\\n]+)"
_DATA = "^data:([^,]*?),(.*)$"


def object_text(text: Column, most_bytes: int) -> Column:
    """A JSON object written anew if it has most_bytes at most; null for anything else."""
    value = F.try_parse_json(text)
    out = F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.to_json(value))
    return F.when(F.octet_length(out) <= most_bytes, out)


def engine_findings(line: Column) -> Column:
    """struct(rule, snippet) of each entry of a line whose `findings` is a list; entries without either are left out."""
    listed = F.from_json(F.get_json_object(line, "$.findings"), "array<struct<rule: struct<id: string>, finding: struct<snippet: string>>>")
    is_list = F.startswith(F.get_json_object(line, "$.findings"), F.lit("["))
    entries = F.transform(listed, lambda x: F.struct(x["rule"]["id"].alias("rule"), x["finding"]["snippet"].alias("snippet")))
    return F.when(is_list, F.filter(entries, lambda x: x["rule"].isNotNull() & x["snippet"].isNotNull()))


def data_url_text(url: Column) -> Column:
    """The text of a data URL, base64 or percent-encoded; null for any other URL."""
    meta, data = F.regexp_extract(url, _DATA, 1), F.regexp_extract(url, _DATA, 2)
    plain = F.when(F.contains(meta, F.lit(";base64")), F.decode(F.try_to_binary(data, F.lit("base64")), "UTF-8")).otherwise(F.try_url_decode(data))
    return F.when(url.rlike(_DATA), plain)


def _last_map(script: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(script, F.lit(_LINE_COMMENT), F.lit(1)), F.lit(-1))


def inline_map(script: Column) -> Column:
    """The source map that the script's last comment carries, if it is an object."""
    text = data_url_text(_last_map(script))
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), text)


def external_map(script: Column) -> Column:
    """The URL of the source map that the script's last comment names, if it is no data URL."""
    last = _last_map(script)
    return F.when(~F.startswith(last, F.lit("data:")), last)


def gate(host: Column, entries: Column, everything: Column, subdomains: Column) -> Column:
    """Whether a capture takes a host: of an empty scope nothing unless everything is wanted, else a domain listed, or below one."""
    names = F.filter(F.transform(entries, lambda e: F.lower(F.trim(e))), lambda e: e != "")
    fits = F.exists(names, lambda e: (host == e) | (subdomains & F.endswith(host, F.concat(F.lit("."), e))))
    return F.when(F.size(entries) == 0, everything).otherwise(fits)


def resolve_specifier(importer: Column, specifier: Column) -> Column:
    """The module that a relative import names, by path arithmetic from its importer; null for a package."""
    scheme = F.regexp_extract(importer, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/", 0)
    path = F.substring(importer, F.length(scheme) + 1, F.length(importer))
    parts = F.filter(F.split(F.concat(F.regexp_replace(path, "[^/]*$", ""), specifier), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(a: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))

    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    rooted = F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), joined)
    return F.when(F.startswith(specifier, F.lit(".")), F.concat(scheme, F.coalesce(F.nullif(rooted, F.lit("")), F.lit("."))))
