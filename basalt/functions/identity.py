"""Content-addressed identities."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Text that JSON writes as it is: printable ASCII without quote and backslash.
PLAIN = "^[\\x20-\\x21\\x23-\\x5B\\x5D-\\x7E]*$"
VERSION = 2


def _inside(value: str | None) -> str | None:
    """The inside of the JSON string of the NFC form."""
    return None if value is None else json.dumps(unicodedata.normalize("NFC", value))[1:-1]


@F.pandas_udf(StringType())
def _escaped(values: pd.Series) -> pd.Series:
    return pd.Series([_inside(v) for v in values], dtype=object)


def _canonical(kind: Column, value: Column) -> Column:
    return F.concat(F.lit('{"type":"'), kind, F.lit(f'","v":{VERSION},"value":"'), value, F.lit('"}'))


def finding_hash(kind: Column, value: Column) -> Column:
    """sha256 of the canonical JSON of type (a plain name), version and NFC value; every row goes to Python, so prefer with_finding_hash."""
    return F.sha2(_canonical(kind, _escaped(value)), 256)


def plain_finding_hash(kind: Column, value: Column) -> Column:
    """finding_hash for values known to be printable ASCII without quote and backslash: no Python in the plan."""
    return F.sha2(_canonical(kind, value), 256)


def with_finding_hash(rows: DataFrame, kind: Column, value: str, name: str = "finding_hash") -> DataFrame:
    """rows with finding_hash; only the distinct values that JSON would escape leave the JVM."""
    plain = F.coalesce(F.col(value).rlike(PLAIN), F.lit(True))
    as_is = rows.where(plain).withColumn(name, F.sha2(_canonical(kind, F.col(value)), 256))
    odd = rows.where(~plain)
    known = odd.select(value).distinct().mapInPandas(lambda frames: (f.assign(_escaped=f[value].map(_inside)) for f in frames), f"`{value}` string, _escaped string")
    return as_is.unionByName(odd.join(known, value).withColumn(name, F.sha2(_canonical(kind, F.col("_escaped")), 256)).select(*as_is.columns))


def occurrence_hash(**fields: Column) -> Column:
    """sha256 of the JSON of the fields in order of name, nulls kept. Texts are printable ASCII without quote and backslash."""
    parts = []
    for k, (name, field) in enumerate(sorted(fields.items())):
        text = field.cast("string")
        quoted = F.concat(F.lit('"'), text, F.lit('"'))
        number = F.when(F.typeof(field).isin("int", "bigint", "smallint", "tinyint", "boolean"), text).otherwise(quoted)
        parts += [F.lit(f'{"," if k else ""}"{name}":'), F.coalesce(number, F.lit("null"))]
    return F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)


def object_key(tenant: Column, run: Column, kind: Column, content: Column) -> Column:
    return F.concat_ws("/", tenant, run, kind, F.sha2(content.cast("binary"), 256))


def short_tag(*fields: Column) -> Column:
    """A tag of 16 hex digits over fields joined by colons; nulls count as `None`."""
    return F.left(F.sha2(F.concat_ws(":", *(F.coalesce(f.cast("string"), F.lit("None")) for f in fields)), 256), F.lit(16))


def json_inside(value: Column) -> Column:
    """The inside of the JSON string of value in ASCII: two signs for quote, backslash and the five named controls, \\uXXXX for all else beyond printable ASCII."""
    code = lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))
    unit = lambda c: F.concat(F.lit("\\u"), code(c))

    def escaped(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        named = F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(n == 8, "\\b").when(n == 9, "\\t").when(n == 10, "\\n").when(n == 12, "\\f").when(n == 13, "\\r")
        rest = n - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(rest, 10)), unit(F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))))
        return named.when((n >= 0x20) & (n < 0x7F), c).when(n > 0xFFFF, pair).otherwise(unit(n))

    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substring(value, i, F.lit(1)))
    return F.when(F.coalesce(value.rlike(PLAIN), F.lit(True)), value).otherwise(F.array_join(F.transform(chars, escaped), ""))


def json_hash(**fields: Column) -> Column:
    """sha256 of the JSON of the fields in order of name; null is null, numbers and truth values stand without quotes, any text is escaped."""
    parts = []
    for k, (name, field) in enumerate(sorted(fields.items())):
        text = field.cast("string")
        bare = F.typeof(field).isin("int", "bigint", "smallint", "tinyint", "boolean")
        parts += [F.lit(f'{"," if k else ""}"{name}":'), F.coalesce(F.when(bare, text).otherwise(F.concat(F.lit('"'), json_inside(text), F.lit('"'))), F.lit("null"))]
    return F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)
