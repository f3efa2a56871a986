"""Batch twins of the keyed streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.views import table
from basalt.streaming import keyed


def c18_single_use(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups as contexts that purchases complete and errors discard; hosts by the value's whole part."""
    kind = F.when(F.col("event_type") == "signup", "context").when(F.col("event_type") == "purchase", "completion").when(F.col("event_type") == "error", "discard")
    low = F.concat(F.when(F.col("value") % 2 < 1, "a").otherwise("b"), F.lit(".example"))
    host = F.when(kind == "completion", F.concat(F.when(F.col("value") % 3 < 1, "www.").otherwise(""), low)).otherwise(low)
    rows = table(spark, sf, "events").select("user_id", "ts", kind.alias("kind"), F.col("event_id").alias("seq"), host.alias("host"))
    return keyed.single_use(rows, "user_id", 48 * 3600).select(F.col("key").alias("user_id"), "context", "completion", "started", "ended")


def m08_fetch_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fetches of twenty hosts: one an hour for each."""
    rows = table(spark, sf, "events").select(F.concat(F.lit("H"), F.pmod("user_id", F.lit(20)).cast("string")).alias("host"), "ts", F.col("event_id").alias("seq"))
    return keyed.fetch_waits(rows, "host", 3600, 1).select(F.col("key").alias("host"), "seq", "at", "wait", "why")


_KIND = "CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 END"
_LOW = "CASE WHEN value % 2 < 1 THEN 'a' ELSE 'b' END || '.example'"
C18 = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS at, {_KIND} AS kind, event_id, {_LOW} AS low, CASE WHEN value % 3 < 1 THEN 'www.' ELSE '' END || {_LOW} AS high FROM events WHERE {_KIND} IS NOT NULL)
SELECT b.user_id, a.event_id AS context, b.event_id AS completion, a.at AS started, b.at AS ended FROM e b JOIN e a ON a.user_id = b.user_id AND b.kind = 1 AND a.kind = 0 AND (a.at, a.kind, a.event_id) < (b.at, b.kind, b.event_id) AND b.at - a.at <= {48 * 3600 * 1_000_000}
  AND (b.high = a.low OR ends_with(b.high, '.' || a.low)) WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.user_id = a.user_id AND (c.at, c.kind, c.event_id) > (a.at, a.kind, a.event_id) AND (c.at, c.kind, c.event_id) < (b.at, b.kind, b.event_id))"""
M08 = """WITH RECURSIVE e AS (SELECT 'h' || CAST(user_id % 20 AS VARCHAR) AS host, event_id AS seq, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events),
g(host, k, seq, "at", wait, open_) AS (SELECT host, k, seq, "at", CAST(0 AS BIGINT), "at" + 3600000000 FROM e WHERE k = 1
  UNION ALL SELECT e.host, e.k, e.seq, e."at", greatest(0, g.open_ - e."at"), CASE WHEN e."at" >= g.open_ THEN e."at" + 3600000000 ELSE g.open_ END FROM g JOIN e ON e.host = g.host AND e.k = g.k + 1),
p AS (SELECT *, row_number() OVER (PARTITION BY "at" // 1000000, wait > 0 ORDER BY "at", seq, host) AS place FROM g)
SELECT host, seq, "at", CASE WHEN wait = 0 AND place > 1 THEN ("at" // 1000000 + 1) * 1000000 - "at" ELSE wait END AS wait, CASE WHEN wait > 0 THEN 'host' WHEN place > 1 THEN 'budget' ELSE 'none' END AS why FROM p"""

QUERIES = {"c18_single_use": (c18_single_use, C18), "m08_fetch_waits": (m08_fetch_waits, M08)}
