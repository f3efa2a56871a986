"""Changes to a table with a check of what they were based on; applying them again changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("applied", "replayed", "conflict")


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])


def judged(current: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """changes with `outcome`, and the version and batch that the key has now (version null: the key is new).

    current: keys, values, version, batch. changes: keys, values, expected (the version they were based on; null:
    none), ord, batch. Of several changes to a key the first by ord (then by value) is considered, the others are
    conflicts; equal rows are one change. A
    change is a replay if its batch is the one that made the key's version: it was applied before.
    """
    change = F.struct("ord", "batch", *values, "expected")
    first = changes.groupBy(*keys).agg(F.min(change).alias("first")).alias("n")
    now = current.select(*keys, "version", F.col("batch").alias("by")).alias("c")
    heads = first.join(now, _same(keys), "left").select(*(F.col(f"n.{k}").alias(k) for k in keys), "n.first", "c.version", "c.by").alias("c")
    rows = changes.alias("n").join(heads, _same(keys)).select("n.*", "c.version", "c.by", "c.first")
    considered = change == F.col("first")
    outcome = F.when(considered & F.col("by").eqNullSafe(F.col("batch")) & F.col("version").isNotNull(), "replayed").when(considered & F.col("expected").eqNullSafe(F.col("version")), "applied").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("first")


def merged(current: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """current after the changes that apply: their values, the next version, their batch."""
    new = judged(current, changes, keys, values).where("outcome = 'applied'").select(*keys, *values, (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"), "batch").distinct()
    n, c = new.alias("n"), current.alias("c")
    joined = c.join(n, _same(keys), "full")
    use = F.col("n.version").isNotNull()
    return joined.select(*(F.when(use, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in [*keys, *values, "version", "batch"]))
