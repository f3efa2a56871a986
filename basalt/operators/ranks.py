"""Places and running sums over whole tables in a total order, without a window over few keys.

Rows are dealt by range to partitions, so every partition is a stretch of the order. Places and sums are counted
within a partition and a key; what all earlier partitions of the key hold is one small row for each partition and
key, summed up by a window over those. A key with a third of all rows is a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources.shared import cut


def ranked(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, place: str = "place", parts: int | None = None) -> DataFrame:
    """rows with `place` (from 1) in the order within the key, and for each (name, column) of sums the running sum.

    Nulls come first and are a key like others; a null adds nothing to a sum. Rows that are equal in the whole
    order take their places in any order. parts: partitions to deal to (default: those of a shuffle).
    """
    sums = sums or {}
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    held = cut(dealt.withColumn("_part", F.spark_partition_id()), "ranked")
    totals = held.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_p"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_n", *(f"_sum_{n}" for n in sums)]))
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    running = here.rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({"_here": F.row_number().over(here)} | {f"_run_{n}": F.coalesce(F.sum(c).over(running), F.lit(0)) for n, c in sums.items()})
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = local.join(earlier, same)
    return out.select(*rows.columns, (F.col("_here") + F.col("_n")).cast("long").alias(place), *((F.col(f"_run_{n}") + F.col(f"_sum_{n}")).alias(n) for n in sums))


def within_limits(rows: DataFrame, keys: list[str], order: list[str], size: str, most_bytes: int, most_rows: int | None = None) -> DataFrame:
    """Rows in order while their running total (column `total`) and number stay within the limits."""
    out = ranked(rows, keys, order, {"total": size})
    keep = F.col("total") <= most_bytes
    return out.where(keep & (F.col("place") <= most_rows) if most_rows is not None else keep).drop("place")
