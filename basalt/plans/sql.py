"""Pieces of DuckDB SQL that the oracle queries share."""

URL = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def segments(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '')"


def joined(items: str, by: str = "/") -> str:
    return f"coalesce(array_to_string({items}, '{by}'), '')"


def entropy(text: str) -> str:
    chars = f"string_split({text}, '')"
    share = f"(len(list_filter({chars}, lambda y: y = x)) / len({chars}))"
    return f"coalesce(list_sum(list_transform(list_distinct({chars}), lambda x: -{share} * log2({share}))), 0.0)"


TEMPLATE = (
    "CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{id}' WHEN regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN '{uuid}'"
    f" WHEN regexp_matches(s, '^[0-9a-fA-F]{{16,}}$') OR (regexp_matches(s, '^[0-9A-Za-z]{{24,}}$') AND regexp_matches(s, '[0-9]') AND {entropy('s')} >= 4.0) THEN '{{hash}}' ELSE s END"
)


def decode_unreserved(text: str) -> str:
    part = "CASE WHEN regexp_matches(p, '^(2[DEde]|3[0-9]|4[1-9A-Fa-f]|5[0-9AFaf]|6[1-9A-Fa-f]|7[0-9AEae])') THEN url_decode('%' || left(p, 2)) || substr(p, 3) ELSE '%' || p END"
    return f"split_part({text}, '%', 1) || coalesce(array_to_string(list_transform(string_split({text}, '%')[2:], lambda p: {part}), ''), '')"


def template_path(path: str) -> str:
    decoded = f"list_transform({segments(path)}, lambda d: {decode_unreserved('d')})"
    return "'/' || " + joined(f"list_transform({decoded}, lambda s: {TEMPLATE})")


def json_text(value: str) -> str:
    """The inside of a JSON string as ASCII, of the composed form of value."""
    code = "ord(c)"
    pair = f"printf('\\u%04x\\u%04x', 55296 + ({code} - 65536) // 1024, 56320 + ({code} - 65536) % 1024)"
    one = f"CASE WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN {code} = 8 THEN '\\b' WHEN {code} = 9 THEN '\\t' WHEN {code} = 10 THEN '\\n' WHEN {code} = 12 THEN '\\f' WHEN {code} = 13 THEN '\\r' WHEN {code} > 65535 THEN {pair} WHEN {code} < 32 OR {code} > 126 THEN printf('\\u%04x', {code}) ELSE c END"
    return f"coalesce(array_to_string(list_transform(regexp_extract_all(nfc_normalize({value}), '(?s).'), lambda c: {one}), ''), '')"


def query_keys(query: str) -> str:
    names = f"list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''), lambda p: regexp_replace(url_decode(split_part(p, '=', 1)), '\\[[0-9]*\\]$', ''))"
    return joined(f"list_sort(list_distinct(list_filter({names}, lambda n: n <> '')))", "&")


def host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({url}, {URL}, 2), '^.*@', ''), ':[0-9]*$', ''))"


#: ep: page_id, run_id, url, host, path, operation, value, finding_hash.
ENDPOINTS = f"""
u AS (SELECT page_id, page_id % 8 AS run_id, url, nullif({host('url')}, '') AS host, regexp_extract(url, {URL}, 3) AS path, regexp_extract(url, {URL}, 4) AS query FROM pages WHERE url IS NOT NULL),
v AS (SELECT page_id, run_id, url, host, path, 'GET ' || {template_path('path')} AS operation, {query_keys('query')} AS keys FROM u),
w AS (SELECT page_id, run_id, url, host, path, operation, keys, operation || CASE WHEN keys <> '' THEN '?' || keys ELSE '' END AS value FROM v),
ep AS (SELECT *, sha256('{{"type":"endpoint","v":2,"value":"' || {json_text('value')} || '"}}') AS finding_hash FROM w)"""

#: links: page_id, run_id, url, ordinal, href.
LINKS = """
l0 AS (SELECT page_id, page_id % 8 AS run_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
links AS (SELECT page_id, run_id, url, unnest(range(len(hrefs))) AS ordinal, unnest(hrefs) AS href FROM l0)"""
