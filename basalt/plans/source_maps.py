"""Source maps that the pages' links stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans import sql
from basalt.sources import source_maps
from basalt.sources.views import links

MOST = 120


def a29_recovered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One map for each page: its links as sources in three folders, every fifth without content, the page's url as content."""
    k = F.col("ordinal")
    folders = F.array(F.lit("webpack:///./src"), F.lit("webpack:///lib/../lib/deep"), F.lit("../.."))
    rows = links(spark, sf).select("page_id", k, F.concat(F.element_at(folders, (k % 3 + 1).cast("int")), F.lower("href")).alias("source"), F.when((F.col("page_id") + k) % 5 > 0, F.concat("url", F.lit(" "), k.cast("string"))).alias("content"))
    each = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source", "content"))).alias("s"))
    # an entry without content is null in the map
    text = F.concat(F.lit('{"version":3,"sources":'), F.to_json("s.source"), F.lit(',"sourcesContent":'), F.to_json("s.content"), F.lit("}"))
    maps = each.select("page_id", text.alias("map"))
    found = source_maps.recovered(maps, "page_id", "map", MOST)
    return found.select("page_id", "path", "content")


A29 = f"""WITH {sql.LINKS},
s AS (SELECT page_id, ordinal AS k, ['src', 'lib/deep', ''][ordinal % 3 + 1] AS folder, regexp_replace(regexp_replace(lower(href), '[?#].*$', ''), '^/', '') AS name, CASE WHEN (page_id + ordinal) % 5 > 0 THEN url || ' ' || CAST(ordinal AS VARCHAR) END AS content FROM links),
p AS (SELECT page_id, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS path, arg_max(content, k) AS content FROM s WHERE content IS NOT NULL GROUP BY ALL),
o AS (SELECT *, list_transform(string_split(path, '/'), lambda x, i: CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END || x) AS walk FROM p),
r AS (SELECT page_id, path, content, sum(strlen(content)) OVER (PARTITION BY page_id ORDER BY walk ROWS UNBOUNDED PRECEDING) AS total FROM o)
SELECT page_id, path, content FROM r WHERE total <= {MOST}"""

QUERIES = {"a29_recovered_sources": (a29_recovered_sources, A29)}
