"""A request as a curl command and as raw HTTP. No control character of what was seen gets into either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basalt.functions.text import control_free

MOST_URL, MOST_BODY = 8192, 65536
#: What stands for a base that isn't known, and the note for the reader.
PLACEHOLDER, NOTE = "{{base_url}}", "# add auth/headers here"
WHOLE = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?"


def _clean(text: Column) -> Column:
    return F.left(control_free(text), F.lit(MOST_URL))


def shell_quoted(text: Column) -> Column:
    plain = text.rlike("^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def _seen(example: Column, path: Column) -> Column:
    return _clean(F.coalesce(F.nullif(example, F.lit("")), path))


def request_parts(example: Column, path: Column, hosts: Column) -> Column:
    """struct(base, origin, host): from the whole URL that was seen, else the first host or a placeholder."""
    seen = _seen(example, path)
    part = lambda k: F.regexp_extract(seen, WHOLE, k)
    first = _clean(F.try_element_at(hosts, F.lit(1)))
    query = F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise("")
    whole = F.struct(F.concat(F.lower(part(1)), F.lit("://"), part(2)).alias("base"), F.concat(F.when(part(3) != "", part(3)).otherwise("/"), query).alias("origin"), part(2).alias("host"))
    relative = F.struct(F.coalesce(F.concat(F.lit("https://"), F.nullif(first, F.lit(""))), F.lit(PLACEHOLDER)).alias("base"), F.coalesce(F.nullif(seen, F.lit("")), F.lit("/")).alias("origin"), F.coalesce(F.nullif(first, F.lit("")), F.lit("HOST")).alias("host"))
    return F.when(seen.rlike(WHOLE), whole).otherwise(relative)


def json_body(names: Column) -> Column:
    """An object of the body's names with `<name>` as values; null without names. Letters beyond ASCII stay as they are."""
    quoted = lambda t: F.regexp_extract(F.to_json(F.array(t)), "^\\[(.*)\\]$", 1)
    pairs = F.transform(F.array_distinct(names), lambda n: F.concat(quoted(n), F.lit(":"), quoted(F.concat(F.lit("<"), n, F.lit(">")))))
    return F.when(F.size(names) > 0, F.left(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), F.lit(MOST_BODY)))


def curl(operation: Column, method: Column, example: Column, path: Column, hosts: Column, content_type: Column, body: Column) -> Column:
    """The lines of a curl command: what it is, a note, the call with its header and body, and further hosts."""
    parts = request_parts(example, path, hosts)
    url = F.left(F.concat(parts["base"], parts["origin"]), F.lit(MOST_URL))
    call = F.concat(F.lit("curl -X "), shell_quoted(_clean(method)), F.lit(" '"), F.replace(url, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    header = F.when(F.coalesce(content_type, F.lit("")) != "", F.concat(F.lit("  -H "), shell_quoted(F.concat(F.lit("Content-Type: "), control_free(content_type)))))
    data = F.concat(F.lit("  --data "), shell_quoted(json_body(body)))
    about = F.concat(F.lit("# "), _clean(operation), F.when(F.size(hosts) > 0, F.concat(F.lit("  (host: "), _clean(F.try_element_at(hosts, F.lit(1))), F.lit(")"))).otherwise("  (host unknown)"))
    others = F.when(F.size(hosts) > 1, F.left(F.concat(F.lit("# other hosts: "), F.array_join(F.transform(F.slice(hosts, F.lit(2), F.greatest(F.size(hosts), F.lit(1))), control_free), ", ")), F.lit(MOST_URL)))
    command = F.array_join(F.array_compact(F.array(call, header, data)), " \\\n")
    return F.array_join(F.array_compact(F.array(about, F.lit(NOTE), command, others)), "\n")


def raw_http(method: Column, example: Column, path: Column, hosts: Column, content_type: Column, body: Column) -> Column:
    """The request as sent: line, host, note, media type, an empty line and the body."""
    parts = request_parts(example, path, hosts)
    media = F.when(F.coalesce(content_type, F.lit("")) != "", F.concat(F.lit("Content-Type: "), control_free(content_type)))
    first = F.concat(_clean(method), F.lit(" "), parts["origin"], F.lit(" HTTP/1.1"))
    return F.array_join(F.array_compact(F.array(first, F.concat(F.lit("Host: "), parts["host"]), F.lit(NOTE), media, F.lit(""), F.coalesce(json_body(body), F.lit("")))), "\n")
