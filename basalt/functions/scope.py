"""Host names and scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
NAME = f"^(?:{LABEL}\\.)+{LABEL}$"


def normalize_host(value: Column) -> Column:
    return F.lower(F.rtrim(F.trim(value), F.lit(".")))


def valid_entry(entry: Column, public_suffixes: list[str]) -> Column:
    """Two labels or more, the last not a number, and no public suffix by itself."""
    named = entry.rlike(NAME) & ~entry.rlike("(?:^|\\.)[0-9]+$")
    return named & ~entry.isin(*public_suffixes) if public_suffixes else named


def normalize_entry(entry: Column, public_suffixes: list[str]) -> Column:
    """The entry lower-cased, without end dot and leading `*.`; null if invalid."""
    plain = F.regexp_replace(normalize_host(entry), "^\\*\\.", "")
    return F.when(valid_entry(plain, public_suffixes), plain)


def in_scope(host: Column, scope: list[str], public_suffixes: list[str]) -> Column:
    """Equal to a valid entry or below it at a dot; no valid entry means nothing is in scope."""
    name = normalize_host(host)
    out = F.lit(False)
    for entry in scope:
        e = normalize_entry(F.lit(entry), public_suffixes)
        out = out | F.coalesce((name == e) | F.endswith(name, F.concat(F.lit("."), e)), F.lit(False))
    return F.coalesce(out, F.lit(False))


def last_labels(host: Column, n: int = 2) -> Column:
    parts = F.split(host, "\\.")
    return F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")).otherwise(host)
