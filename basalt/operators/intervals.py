"""Intervals and runs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts that the rows of one key are dealt to before the last step.
PARTS = 32


def _islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def merge_spans(rows: DataFrame, keys: list[str], start: str, end: str, slot: int | None = None) -> DataFrame:
    """Spans that overlap or touch, united, for each key. With slot, spans that start in one slot of that width are united first, so that a hot key is spread."""
    if slot:
        rows = _islands(rows.select(*keys, start, end).withColumn("slot", F.floor(F.col(start) / slot)), [*keys, "slot"], start, end).drop("slot")
    return _islands(rows, keys, start, end)


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    return rows.withColumn("dealt", F.pmod(F.xxhash64(*order), F.lit(PARTS)))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Rows in order as long as the running total stays within the budget.

    A key's rows are dealt to parts first. What is beyond the budget in its part, but for the first such row,
    is beyond it in the whole, so few rows of a hot key reach the last window.
    """
    part = Window.partitionBy(*keys, "dealt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = _dealt(rows, order).withColumn("running", F.sum(size).over(part)).where(F.col("running") - F.col(size) <= most).drop("running", "dealt")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most)


def latest(rows: DataFrame, keys: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """The row of the highest order for each key, by an aggregate that needs no sort."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *kept)).alias("top")).select(*keys, *(F.col(f"top.{c}") for c in dict.fromkeys([*order, *kept])))


def first_n(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each key; `capped` tells whether more were there. Each part of a key is cut before the whole is ranked."""
    part = Window.partitionBy(*keys, "dealt").orderBy(*order)
    # one row more for each key tells of the rest
    near = _dealt(rows, order).withColumn("place", F.row_number().over(part)).where(F.col("place") <= most + 1).drop("place", "dealt")
    w = Window.partitionBy(*keys)
    ranked = near.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("capped", F.count(F.lit(1)).over(w) > most)
    return ranked.where(F.col("place") <= most)


def within_after(contexts: DataFrame, completions: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Rows `a` of contexts with rows `b` of completions of the same key up to so many seconds later, joined by slots of that width."""
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))
    a = contexts.withColumn("slot", F.explode(F.array(slot, slot + 1))).alias("a")
    b = completions.withColumn("slot", slot).alias("b")
    limit = F.make_dt_interval(secs=F.lit(seconds))
    within = (F.col(f"b.{time}") >= F.col(f"a.{time}")) & (F.col(f"b.{time}") <= F.col(f"a.{time}") + limit)
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.slot") == F.col("b.slot")) & within)
