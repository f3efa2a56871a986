"""URL parts, path templates and query keys.

URLs are split by the RFC 3986 expression, never by parse_url, which rejects templates such as `/{id}`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Group of each part in URL.
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5

INTEGER = "^[0-9]+$"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_RUN = "^[0-9a-fA-F]{16,}$"
TOKEN = "^[0-9A-Za-z]{24,}$"
#: Bits for each character from which a long token counts as random.
TOKEN_ENTROPY = 4.0


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, AUTHORITY), "^.*@", ""), ":[0-9]*$", ""))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for each character, 0 for empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)

    def add(total: Column, c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), add)


def template_segment(segment: Column) -> Column:
    """`{id}`, `{uuid}` or `{hash}` for a segment that names one thing among many, else the segment."""
    random = segment.rlike(TOKEN) & segment.rlike("[0-9]") & (entropy(segment) >= TOKEN_ENTROPY)
    return F.when(segment.rlike(INTEGER), "{id}").when(segment.rlike(UUID), "{uuid}").when(segment.rlike(HEX_RUN) | random, "{hash}").otherwise(segment)


#: Two hex digits of a letter, a digit or one of `-._~`.
UNRESERVED = "^(2[DEde]|3[0-9]|4[1-9A-Fa-f]|5[0-9AFaf]|6[1-9A-Fa-f]|7[0-9AEae])"


def decode_unreserved(text: Column) -> Column:
    """Percent-decode letters, digits and `-._~` alone, so that no separator can appear."""
    parts = F.split(text, "%")
    decoded = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.when(p.rlike(UNRESERVED), F.concat(F.chr(F.conv(F.left(p, F.lit(2)), 16, 10).cast("int")), F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p)))
    return F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def template_path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(path), lambda s: template_segment(decode_unreserved(s))), "/"))


def query_keys(query: Column) -> Column:
    """Names of a query string, decoded, without trailing index, sorted and distinct, joined by `&`; values are dropped."""

    def name(pair: Column) -> Column:
        raw = F.split_part(pair, F.lit("="), F.lit(1))
        return F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), r"\[[0-9]*\]$", "")

    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), name)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), "&")


def operation(method: Column, url: Column) -> Column:
    return F.concat_ws(" ", F.upper(F.trim(method)), template_path(part(url, PATH)))


def endpoint(method: Column, url: Column) -> Column:
    """struct(operation, value, host): the identity of a request, with its query keys but without their values."""
    keys, op, name = query_keys(part(url, QUERY)), operation(method, url), host(url)
    return F.struct(op.alias("operation"), F.when(keys != "", F.concat(op, F.lit("?"), keys)).otherwise(op).alias("value"), F.when(name != "", name).alias("host"))


def operation_of_param(value: Column) -> Column:
    """The operation in a parameter's value: all before the last space."""
    return F.regexp_replace(value, " [^ ]*$", "")


def operation_of(value: Column) -> Column:
    """The operation in an endpoint's value."""
    return F.split_part(value, F.lit("?"), F.lit(1))


#: Shapes of references that name a page or an endpoint, and of those that name a style, an image or a font.
ROUTE = "^(https?://[^/]|/[^/])"
NOT_IN_ROUTE = '[\\x00-\\x20<>"|^`*;,]'
ASSET = "\\.(css|png|jpe?g|gif|svg|ico|woff2?|ttf|map)([?#].*)?$"


def looks_like_route(ref: Column) -> Column:
    return ref.rlike(ROUTE) & ~ref.rlike(NOT_IN_ROUTE) & ~F.lower(ref).rlike(ASSET)


def reference_kind(ref: Column) -> Column:
    return F.when(ref.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"), "absolute").when(F.startswith(ref, F.lit("/")), "root").when(F.startswith(ref, F.lit(".")), "relative").otherwise("package")


def glob_match(url: Column, patterns: list[str]) -> Column:
    """Whether a pattern with `*` fits: one that starts with `/` the path, one with `/` inside host and path, else the host; any case."""
    name, path = host(url), F.lower(part(url, PATH))
    out = F.lit(False)
    for pattern in patterns:
        regex = "^" + "".join(".*" if c == "*" else c if c.isalnum() or c == "/" else "\\" + c for c in pattern.lower()) + "$"
        subject = path if pattern.startswith("/") else F.concat(name, path) if "/" in pattern else name
        out = out | subject.rlike(regex)
    return out
