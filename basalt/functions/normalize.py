"""Stable values of findings: parameters, secrets, source paths, hosts and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basalt.functions import urls
from basalt.functions.scope import NAME

#: Delimiters around a secret, the pinned provider of a rule, and the names of missing sources.
SECRET_DELIMITERS = "\"'`()[]{}<>,;: \t\r\n"
PINNED_PROVIDERS = {"custom.aws.akia_standalone": "aws"}
ENGINE = "kingfisher"
NULL_SOURCE = "{null-source}"
#: Bits for each character from which a part of a file name counts as a content hash.
PATH_ENTROPY = 3.0


def param_value(operation: Column, location: Column, name: Column) -> Column:
    return F.concat(operation, F.lit(" "), location, F.lit(":"), name)


def provider(rule: Column) -> Column:
    """The provider that a rule's id names: pinned, else the engine's second part, else the first."""
    key = F.lower(F.trim(rule))
    parts = F.filter(F.split(key, "[./_-]"), lambda p: p != "")
    pinned = F.create_map(*(F.lit(x) for item in PINNED_PROVIDERS.items() for x in item))
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.coalesce(F.try_element_at(pinned, key), F.when(first == ENGINE, second).otherwise(first), F.lit("unknown"))


def secret_value(token: Column, rule: Column) -> Column:
    """provider and sha256 of the token without delimiters around it; the token itself appears nowhere."""
    return F.concat(provider(rule), F.lit(":"), F.sha2(F.btrim(token, F.lit(SECRET_DELIMITERS)).cast("binary"), 256))


def collapse_hashes(segment: Column) -> Column:
    """`{hash}` for the content hashes of a file name: hex with a digit anywhere but as extension, and behind the stem other random parts."""
    parts = F.filter(F.split(segment, "[._-]"), lambda p: p != "")
    marks = F.regexp_replace(segment, "[^._-]+", "\u0001")

    def one(part: Column, at: Column) -> Column:
        hexed = part.rlike("^[0-9a-fA-F]{6,}$") & part.rlike("[0-9]")
        wordish = (at > 0) & part.rlike("^[A-Za-z0-9]{8,}$") & (urls.entropy(part) >= PATH_ENTROPY)
        extension = (at == F.size(parts) - 1) & (F.size(parts) > 1)
        return F.when(~extension & (hexed | wordish), F.lit("{hash}")).otherwise(part)

    # the separators lie between the marks, one part for each mark
    gaps = F.split(marks, "\u0001")
    named = F.transform(parts, one)
    whole = F.zip_with(gaps, named, lambda g, p: F.concat(F.coalesce(g, F.lit("")), F.coalesce(p, F.lit(""))))
    return F.array_join(whole, "")


def source_path(source: Column) -> Column:
    """A source's path without scheme, `.` and `..` resolved below its authority, content hashes collapsed."""
    text = F.trim(source)
    scheme = "(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):(//)?(.*)$"
    has = text.rlike(scheme)
    rest, slashes = F.regexp_extract(text, scheme, 3), F.regexp_extract(text, scheme, 2)
    owned = has & (slashes == "//")
    authority = F.when(owned, F.lower(F.split_part(rest, F.lit("/"), F.lit(1)))).otherwise(F.lit(""))
    path = F.when(owned, F.regexp_replace(rest, "^[^/]*/?", "")).when(has, F.regexp_replace(rest, "^/+", "")).otherwise(text)
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(parts, empty, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    whole = F.concat(F.when(authority != "", F.array(authority)).otherwise(empty), F.transform(resolved, collapse_hashes))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NULL_SOURCE)).otherwise(F.array_join(whole, "/"))


def attributed_host(url: Column) -> Column:
    """The host of an http(s) URL if it is a valid name and no part of it is unresolved; else null."""
    name = urls.host(url)
    fit = F.lower(urls.part(url, urls.SCHEME)).isin("http", "https") & ~F.contains(urls.part(url, urls.AUTHORITY), F.lit("EXPR")) & name.rlike(NAME) & ~name.rlike("(?:^|\\.)[0-9]+$")
    return F.when(fit, name)


def target_host(target: Column) -> Column:
    """The host in the first word of a target, which may lack a scheme."""
    word = F.element_at(F.split(F.trim(target), "\\s+"), 1)
    return urls.host(F.when(F.contains(word, F.lit("://")), word).otherwise(F.concat(F.lit("https://"), word)))


def navigable_url(target: Column) -> Column:
    return F.when(F.contains(target, F.lit("://")), target).otherwise(F.concat(F.lit("https://"), target))


def bare_domain(target: Column) -> Column:
    return urls.part(navigable_url(target), urls.PATH).isin("", "/")


def resolve_reference(ref: Column, base: Column) -> Column:
    """ref against base: absolute ones stay, those of a root or a directory are joined; null for a package's name."""
    root = F.concat(urls.part(base, urls.SCHEME), F.lit("://"), urls.part(base, urls.AUTHORITY))
    empty = F.array().cast("array<string>")

    def joined(path: Column) -> Column:
        parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
        out = F.aggregate(parts, empty, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
        return F.concat(root, F.lit("/"), F.array_join(out, "/"))

    folder = F.regexp_replace(urls.part(base, urls.PATH), "[^/]*$", "")
    kind = urls.reference_kind(ref)
    shared = F.startswith(ref, F.lit("//"))
    return F.when(shared, F.concat(urls.part(base, urls.SCHEME), F.lit(":"), ref)).when(kind == "absolute", ref).when(kind == "root", joined(ref)).when(kind == "relative", joined(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref)))
