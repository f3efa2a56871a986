"""Original files out of source maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators import ranks

MOST_BYTES = 32 << 20


def safe_path(source: Column) -> Column:
    """The path of a source below the map's own folder: no scheme, no empty or dot steps, `..` never above the folder; null if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(F.translate(source, "\\", "/"), "^[A-Za-z][A-Za-z0-9+.-]*:/*", ""), "[?#].*$", "")
    steps = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.nullif(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"), F.lit(""))


def walk_order(path: Column) -> Column:
    """A key that sorts paths as a walk does: in each folder its files, then its folders."""
    steps = F.split(path, "/")
    return F.transform(steps, lambda p, k: F.concat(F.when(k == F.size(steps) - 1, F.lit("0")).otherwise(F.lit("1")), p))


def recovered(maps: DataFrame, map_id: str, text: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """map_id, path, content of the files of every map, in walk order as long as a map's total stays within most_bytes.

    Sources without content give no file; of sources with one path the last counts. A text that is no map gives
    no rows. sourceRoot comes before every source.
    """
    shape = "struct<sourceRoot: string, sources: array<string>, sourcesContent: array<string>>"
    parsed = maps.select(map_id, F.from_json(text, shape).alias("m"))
    files = parsed.select(map_id, F.col("m.sourceRoot").alias("root"), F.posexplode(F.arrays_zip("m.sources", "m.sourcesContent")).alias("k", "f"))
    root = F.when(F.coalesce("root", F.lit("")) != "", F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"))).otherwise("")
    named = files.select(map_id, "k", safe_path(F.concat(root, "f.sources")).alias("path"), F.col("f.sourcesContent").alias("content")).where("path IS NOT NULL AND content IS NOT NULL")
    once = named.groupBy(map_id, "path").agg(F.max_by("content", "k").alias("content"))
    sized = once.withColumns({"walk": walk_order(F.col("path")), "size": F.octet_length("content").cast("long")})
    return ranks.within_limits(sized, [map_id], ["walk"], "size", most_bytes).select(map_id, "path", "content")
