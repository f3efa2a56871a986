"""Modules, exports and imports that the pages' links stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import modules
from basalt.plans import sql
from basalt.sources.views import links


def c13_import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A page is the module of its first link's word; further links export names, pass names on, and all import one."""
    rows = links(spark, sf).select("page_id", F.pmod("run_id", F.lit(2)).alias("build"), F.col("ordinal").cast("long").alias("k"), F.regexp_replace("href", "^/", "").alias("word"), "url")
    endings = F.array(*map(F.lit, ("", ".js", ".ts", "/index.js")))
    named = rows.where("k = 0").select(F.col("page_id").alias("p"), F.concat(F.lit("src/"), "word", F.element_at(endings, (F.pmod("page_id", F.lit(4)) + 1).cast("int"))).alias("module"))
    own = rows.join(named, F.col("page_id") == F.col("p")).withColumn("ord", F.col("page_id") * 100 + F.col("k"))
    name = lambda c, m: F.concat(F.lit("n"), F.pmod(c, F.lit(m)).cast("string"))
    specifier = F.concat(F.lit("./"), "word")
    exports = own.where("k BETWEEN 1 AND 3").select("build", "module", name(F.col("k"), 3).alias("name"), F.concat("url", F.lit(" "), F.col("k").cast("string")).alias("value"), "ord")
    passed_on = own.where("k > 3").select("build", "module", name(F.col("k") + F.col("page_id"), 6).alias("name"), specifier.alias("specifier"), name(F.col("page_id"), 6).alias("imported"))
    imports = own.select("build", F.col("module").alias("importer"), F.concat(F.lit("l"), F.col("k").cast("string")).alias("local"), name(F.col("k") + F.col("page_id"), 6).alias("imported"), specifier.alias("specifier"), "ord")
    return modules.resolved(imports, exports, passed_on, ("build",))


_TRIED = ", ".join(f"'{e}'" for e in modules.ENDINGS)
C13 = f"""WITH RECURSIVE {sql.LINKS},
r AS (SELECT page_id, run_id % 2 AS build, ordinal AS k, regexp_replace(href, '^/', '') AS word, url FROM links),
o AS (SELECT r.*, 'src/' || f.word || ['', '.js', '.ts', '/index.js'][CAST(r.page_id % 4 AS BIGINT) + 1] AS module, 'src/' || CASE WHEN r.page_id % 4 = 3 THEN f.word || '/' ELSE '' END || r.word AS target FROM r JOIN r f ON f.page_id = r.page_id AND f.k = 0),
x AS (SELECT build, module, 'n' || CAST(k % 3 AS VARCHAR) AS name, arg_min(url || ' ' || CAST(k AS VARCHAR), page_id * 100 + k) AS value FROM o WHERE k BETWEEN 1 AND 3 GROUP BY ALL),
y AS (SELECT DISTINCT build, module, 'n' || CAST((k + page_id) % 6 AS VARCHAR) AS name, target, 'n' || CAST(page_id % 6 AS VARCHAR) AS imported FROM o WHERE k > 3),
offers AS (SELECT build, module, name FROM x UNION SELECT build, module, name FROM y),
ends_with_ AS (SELECT unnest([{_TRIED}]) AS e, unnest(range({len(modules.ENDINGS)})) AS rank),
p AS (SELECT y.build, y.module, y.name, arg_min((t.module, t.name), (rank, t.module, t.name)) AS t FROM y JOIN ends_with_ ON true JOIN offers t ON t.build = y.build AND t.module = y.target || e AND t.name = y.imported
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.build = y.build AND x.module = y.module AND x.name = y.name) GROUP BY y.build, y.module, y.name),
i AS (SELECT o.build, o.module AS importer, 'l' || CAST(k AS VARCHAR) AS local, page_id * 100 + k AS ord, arg_min((t.module, t.name), rank) AS t FROM o JOIN ends_with_ ON true JOIN offers t ON t.build = o.build AND t.module = o.target || e AND t.name = 'n' || CAST((k + page_id) % 6 AS VARCHAR) GROUP BY ALL),
walk(build, importer, local, ord, t, hops) AS (SELECT build, importer, local, ord, t, 0 FROM i UNION ALL SELECT w.build, w.importer, w.local, w.ord, p.t, hops + 1 FROM walk w JOIN p ON p.build = w.build AND (p.module, p.name) = w.t WHERE hops < 60)
SELECT w.build, importer, local, arg_max(x.value, w.ord) AS value FROM walk w JOIN x ON x.build = w.build AND (x.module, x.name) = w.t GROUP BY ALL"""

QUERIES = {"c13_import_resolution": (c13_import_resolution, C13)}
