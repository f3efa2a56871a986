"""The first candidate of each key that resolves, by rounds of probing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.operators import ranks
from basalt.sources.shared import cut


def first_resolvable(occurrences: DataFrame, blobs: DataFrame, key: str, order: list[str], ref: str, blob: str) -> tuple[DataFrame, int]:
    """(the row of `occurrences` that serves each key, with `resolved`; the number of rounds).

    Candidates are placed in their order over the whole table. Round n looks the next 2^n places of each key that
    is still open up in `blobs`, so few references are looked up at all and no key's candidates meet in a task.
    A key of which none resolves gives its first candidate, with resolved false; no candidates, no row.
    """
    placed = cut(ranks.ranked(occurrences, [key], order), "candidates")
    known = blobs.select(F.col(blob).alias("_blob")).where("_blob IS NOT NULL").distinct()
    last = placed.agg(F.max("place").alias("n")).first().n or 0
    served: list[DataFrame] = []
    open_, low, rounds = placed, 1, 0
    while low <= last and not open_.isEmpty():
        rounds += 1
        high = 2 * low - 1
        tried = open_.where(F.col("place").between(low, high))
        hit = tried.join(known, F.col(ref) == F.col("_blob"), "left_semi")
        best = cut(hit.groupBy(F.col(key).alias("_key")).agg(F.min("place").alias("_place")), "served")
        served.append(best)
        open_ = cut(open_.where(F.col("place") > high).join(best, F.col(key).eqNullSafe(F.col("_key")), "left_anti"), "open")
        low = high + 1
    found = reduce(DataFrame.unionAll, served) if served else placed.select(F.col(key).alias("_key"), F.col("place").alias("_place")).where(F.lit(False))
    both = placed.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    out = both.where(F.col("place") == F.coalesce("_place", F.lit(1)))
    return out.select(*occurrences.columns, F.col("_place").isNotNull().alias("resolved")), rounds


def reveal_candidates(occurrences: DataFrame, blobs: DataFrame) -> tuple[DataFrame, int]:
    """The occurrence that each finding's value can be shown from: with offsets, by path, start and hash, the first whose blob is there.

    occurrences: finding_hash, source_path, offset_start, offset_end, occurrence_hash, input_ref. blobs: ref.
    """
    own = occurrences.where("offset_start IS NOT NULL AND offset_end IS NOT NULL").withColumn("_path", F.coalesce("source_path", F.lit("")))
    found, rounds = first_resolvable(own, blobs, "finding_hash", ["_path", "offset_start", "occurrence_hash"], "input_ref", "ref")
    return found.drop("_path").withColumn("input_ref", F.when(F.col("resolved"), F.col("input_ref"))), rounds
