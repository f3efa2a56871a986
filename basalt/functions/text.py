"""Column builders over source texts: offsets, shapes and secrets (hashes only, never values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name, pattern of the secret with the token in group 1.
SECRET_RULES = (("aws.access_key_id", "\\b(AKIA[0-9A-Z]{16})\\b"), ("generic.hex", "([0-9a-f]{32,})"))
#: Name and pattern of what a viewer counts as a likely secret.
_QUOTED = "[\\t\\n\\x0B\\f\\r ]*[:=][\\t\\n\\x0B\\f\\r ]*['\"`]([^'\"`]+)['\"`]"
LIKELY_SECRETS = (
    ("client.api_key", "(?i)(api[_-]?key|apikey)" + _QUOTED),
    ("client.password", "(?i)(secret|password|pwd)" + _QUOTED),
    ("client.token", "(?i)(token|bearer)" + _QUOTED),
    ("client.live_secret", "sk_live_[a-zA-Z0-9]{24,}"),
    ("client.live_public", "pk_live_[a-zA-Z0-9]{24,}"),
    ("client.access_key", "AKIA[0-9A-Z]{16}"),
    ("client.jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)
MOST_SECRETS = 999
LONG_LINE, LOOKED_AT = 500, 200


def byte_offset(source: Column, line: Column, column: Column) -> Column:
    """UTF-8 bytes before (line from 1, column from 0); null beyond the text."""
    lines = F.split(source, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda a, x: a + F.octet_length(x) + 1)
    own = F.get(lines, line - 1)
    return F.when(F.length(own) >= column, before + F.octet_length(F.left(own, column)))


def minified(source: Column) -> Column:
    """Whether one of the first 200 lines has over 500 characters."""
    return F.exists(F.slice(F.split(source, "\n"), 1, LOOKED_AT), lambda x: F.length(x) > LONG_LINE)


def control_free(source: Column) -> Column:
    return F.regexp_replace(source, "[\\x00-\\x1F\\x7F]", "")


def secret_count(source: Column) -> Column:
    """Distinct likely secrets, MOST_SECRETS at most as shown to a reader."""
    found = [F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(p), F.lit(0)) for _, p in LIKELY_SECRETS]
    return F.least(F.size(F.array_distinct(F.concat(*found))), F.lit(MOST_SECRETS))


def secret_sightings(rows: DataFrame, id_col: str, text_col: str, rules: tuple = SECRET_RULES) -> DataFrame:
    """id, rule, secret (rule's provider and sha256), n_th, offset_start, offset_end (UTF-8 bytes) of every match; n_th: of the same text of a rule, from 1.

    Texts split at a rule's matches; what lies between them gives the offsets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    matches = F.array(*(F.struct(F.lit(n).alias("rule"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"), F.split(text, p, -1).alias("gaps")) for n, p in rules))
    rows = rows.select(F.col(id_col).alias("id"), F.explode(matches).alias("r")).where("size(r.m) > 0")
    step = "concat(a, array(if(size(a) = 0, octet_length(r.gaps[0]), element_at(a, -1) + octet_length(r.m[i - 1]) + octet_length(r.gaps[i]))))"
    starts = F.expr(f"aggregate(sequence(0, size(r.m) - 1), CAST(array() AS array<int>), (a, i) -> {step})")
    rows = rows.select("id", "r.rule", F.explode(F.arrays_zip(F.col("r.m").alias("m"), starts.alias("s"))).alias("x"))
    provider = F.split_part("rule", F.lit("."), F.lit(1))
    out = rows.select("id", "rule", F.concat(provider, F.lit(":"), F.sha2(F.col("x.m").cast("binary"), 256)).alias("secret"), F.col("x.s").alias("offset_start"), (F.col("x.s") + F.octet_length("x.m")).alias("offset_end"))
    w = Window.partitionBy("id", "rule", "secret").orderBy("offset_start")
    return out.withColumn("n_th", F.row_number().over(w))


def secret_holds(source: Column, start: Column, end: Column, secret: Column) -> Column:
    """Whether the bytes at the offsets still have the stored hash; the value itself is never returned."""
    part = F.substring(F.encode(source, "UTF-8"), start + 1, end - start)
    return F.sha2(part, 256) == F.split_part(secret, F.lit(":"), F.lit(2))
