"""Addresses of both kinds, made of the events' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import addresses
from basalt.sources.views import table

#: First groups of the addresses; the rest comes from the md5 of the event's id.
HEADS = ["2001:db8", "fc12", "fe80", "2002:0a00", "2002:0808", "2001:0020", "2001:0004:0112", "0064:ff9b:0001", "ff02", "fec0", "2600", "0000:0000:0000:0000:0000:ffff:7f00", "0000:0000:0000:0000:0000:ffff:0808", "2001", "0100", "4000"]
#: hexadecimal first and last address of the ranges that are public; inside 2000::/3 what isn't; inside that what is again.
PUBLIC = [("2000", "3fff"), ("fec0", "feff")]
CLOSED = [("20010000", "200101ff"), ("20010db8", "20010db8"), ("2002", "2002")]
OPEN = [("20010003", "20010003"), ("200100040112", "200100040112"), ("20010020", "2001002f"), ("20010030", "2001003f")]


def b08_public_ip(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses written in full, without leading zeros, as IPv4 or with one group too many."""
    digits = F.md5(F.col("event_id").cast("string").cast("binary"))
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.pmod("event_id", F.lit(len(HEADS))) + 1).cast("int"))
    full = F.left(F.concat(F.replace(head, F.lit(":"), F.lit("")), digits), F.lit(32))
    groups = F.regexp_extract_all(full, F.lit("[0-9a-f]{4}"), F.lit(0))
    short = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")
    four = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10)), ".")
    form = F.pmod(F.col("user_id"), F.lit(4))
    text = F.when(form == 0, F.array_join(groups, ":")).when(form == 1, F.upper(F.regexp_replace(short, "^(0:){5}", "::"))).when(form == 2, four).otherwise(F.concat(short, F.lit(":1")))
    rows = table(spark, sf, "events").select("event_id", text.alias("address"))
    return addresses.with_public(rows, "address")


def _within(text: str, ranges: list[tuple[str, str]]) -> str:
    return "(" + " OR ".join(f"left({text}, {len(a)}) BETWEEN '{a}' AND '{b}'" for a, b in ranges) + ")"


_DEAL = "[" + ", ".join(f"'{h}'" for h in HEADS) + f"][CAST(event_id % {len(HEADS)} AS BIGINT) + 1]"
_FOUR = " || '.' || ".join(f"CAST(CAST('0x' || substr(d, {2 * k + 1}, 2) AS INTEGER) AS VARCHAR)" for k in range(4))
#: Of an IPv4 address as eight hexadecimal digits: what isn't public, in bits; two addresses in between are.
_CLOSED4 = "(left(v, 2) IN ('00', '0a', '7f') OR left(v, 4) IN ('a9fe', 'c0a8') OR left(v, 6) IN ('c00000', 'c00002', 'c63364', 'cb0071') AND v NOT IN ('c0000009', 'c000000a') OR v BETWEEN '64400000' AND '647fffff' OR v BETWEEN 'ac100000' AND 'ac1fffff' OR left(v, 4) IN ('c612', 'c613') OR v >= 'e0000000')"
B08 = f"""WITH e AS (SELECT event_id, user_id % 4 AS form, md5(CAST(event_id AS VARCHAR)) AS d, left(replace({_DEAL}, ':', '') || md5(CAST(event_id AS VARCHAR)), 32) AS f FROM events),
g AS (SELECT *, list_transform(range(8), lambda k: substr(f, CAST(k * 4 + 1 AS BIGINT), 4)) AS groups FROM e),
t AS (SELECT *, array_to_string(list_transform(groups, lambda x: regexp_replace(x, '^0{{1,3}}', '')), ':') AS short FROM g),
a AS (SELECT event_id, form, f, d, CASE form WHEN 0 THEN array_to_string(groups, ':') WHEN 1 THEN upper(regexp_replace(short, '^(0:){{5}}', '::')) WHEN 2 THEN {_FOUR} ELSE short || ':1' END AS address,
  CASE WHEN form = 2 THEN left(d, 8) WHEN left(f, 24) = '00000000000000000000ffff' THEN substr(f, 25, 8) WHEN left(f, 4) = '2002' THEN substr(f, 5, 8) END AS v FROM t)
SELECT event_id, address, CASE WHEN form = 3 THEN false WHEN v IS NOT NULL THEN NOT {_CLOSED4} ELSE {_within('f', PUBLIC)} AND (NOT {_within('f', CLOSED)} OR {_within('f', OPEN)} OR f IN ('20010001000000000000000000000001', '20010001000000000000000000000002')) END AS public FROM a"""

QUERIES = {"b08_public_ip": (b08_public_ip, B08)}
