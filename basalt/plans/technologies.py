"""Technology detection over the pages, with rules that the pages' own links and words give.

A page's signals: its language as a header, its query keys as cookies, its title as meta generator, its links as
script sources, its markup as a script text. The rules: one for each distinct link, one for each distinct word of
a title as the name of a global, and a few fixed ones for the other surfaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import urls
from basalt.operators import fingerprints
from basalt.plans import sql
from basalt.sources.views import table

#: tech, surface, key, value of the rules that don't come from the pages.
FIXED_RULES = [
    ("language", "header", "content-language", "^([a-z])([a-z])$\\;version:\\1\\2?\\2.x:none"),
    ("english", "header", "content-language", "EN\\;confidence:40"),
    ("paged", "cookie", "page", "\\;confidence:60"),
    ("referred", "cookie", "ref", "\\;confidence:30"),
    ("titled", "meta", "generator", "^([a-z]+) ([a-z]+)\\;version:\\2\\;confidence:50"),
    ("titled", "meta", "generator", "([a-z]+)[.]?$\\;version:\\1\\;confidence:20"),
    ("described", "meta", "description", "."),
    ("articles", "script_src", "", "^/(th|de)\\;version:\\1\\;confidence:10"),
    ("bare", "scripts", "", "\\;confidence:5"),
    ("ahead", "scripts", "", "track(?=\\()"),
    ("again", "header", "content-language", "([a-z])\\1"),
]


def _host(url: Column) -> Column:
    return F.coalesce(urls.host(url), F.lit(""))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """host, surface, key, value, ord (by page) of all pages."""
    pages = table(spark, sf, "pages").where("url IS NOT NULL AND html IS NOT NULL").select(_host(F.col("url")).alias("host"), "page_id", "url", "html")
    keys = F.transform(F.filter(F.split(F.regexp_extract("url", "\\?([^#]*)", 1), "&"), lambda p: p != ""), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    one = lambda surface, key, value: F.struct(F.lit(surface).alias("surface"), key.alias("key"), value.alias("value"))
    none = F.lit(None).cast("string")
    fixed = F.array(
        one("header", F.lit("content-language"), F.regexp_extract("html", 'lang="([^"]*)"', 1)),
        one("meta", F.lit("generator"), F.regexp_extract("html", "<title>([^<]*)", 1)),
        one("meta", F.lit("description"), F.regexp_extract("html", "<h1>([^<]*)", 1)),
        one("scripts", none, F.col("html")),
    )
    cookies = F.transform(keys, lambda k: one("cookie", k, none))
    sources = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: one("script_src", none, h))
    return pages.select("host", F.col("page_id").alias("ord"), F.explode(F.concat(fixed, cookies, sources)).alias("s")).select("host", "s.*", "ord")


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word of ASCII letters of the pages' titles."""
    found = F.regexp_extract_all(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf, "pages").where("html IS NOT NULL").select(F.explode(found).alias("w")).distinct()


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """tech, surface, key, value, ord: the fixed rules, then a rule for each link, then one for each word."""
    fixed = spark.createDataFrame([(*r, k) for k, r in enumerate(FIXED_RULES)], "tech string, surface string, key string, value string, ord long")
    hrefs = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h")).distinct()
    literal = F.regexp_replace("h", "([.*+?^$|()\\[\\]{}\\\\])", "\\\\$1")
    of_links = hrefs.select(F.concat(F.lit("link "), F.lower(F.left("h", F.lit(3)))).alias("tech"), F.lit("scripts").alias("surface"), F.lit("").alias("key"), F.concat(F.lit('href="'), literal, F.lit('"([^>]*)>\\;confidence:9')).alias("value"), F.lit(100).cast("long").alias("ord"))
    of_words = words(spark, sf).select(F.concat(F.lit("word "), F.lower(F.left("w", F.lit(2)))).alias("tech"), F.lit("js").alias("surface"), F.col("w").alias("key"), F.lit("\\;confidence:7").alias("value"), F.lit(200).cast("long").alias("ord"))
    return fixed.unionByName(of_links).unionByName(of_words)


def j05_globals(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of every group of globals on every host."""
    only = fingerprints.parsed_rules(rules(spark, sf).where("surface = 'js'"))
    return fingerprints.detections(signals(spark, sf).where("surface = 'scripts'"), only).select("host", "tech", "confidence", F.size("evidence").cast("long").alias("names"))


def j06_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the patterns made of the titles' words are usable, by their form."""
    form = F.pmod(F.length("w"), F.lit(6))
    made = F.when(form == 0, F.concat(F.lit("(?="), "w", F.lit(")"))).when(form == 1, F.concat(F.lit("("), "w", F.lit(")\\1"))).when(form == 2, F.concat(F.lit("["), "w")).when(form == 3, F.concat("w", F.lit("(?<!x)"))).when(form == 4, F.concat(F.lit("^(?:"), "w", F.lit(")+[0-9]{1,3}$"))).otherwise(F.concat(F.lit("\\b"), "w", F.lit("\\b")))
    given = words(spark, sf).select(F.lit("t").alias("tech"), F.concat(F.lit("form "), form.cast("string")).alias("surface"), F.lit("").alias("key"), made.alias("value"))
    return fingerprints.rejects(fingerprints.parsed_rules(given)).select("surface", "accepted", "rejected")


def j08_technologies(spark: SparkSession, sf: str) -> DataFrame:
    """All rules against all surfaces of all pages."""
    found = fingerprints.detections(signals(spark, sf), fingerprints.parsed_rules(rules(spark, sf)))
    return found.select("host", "tech", "confidence", "version", F.array_join("other_versions", ",").alias("other_versions"))


HOST = f"coalesce({sql.host('url')}, '')"
WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)', 1), '[A-Za-z]+')) AS w FROM pages WHERE html IS NOT NULL)"
PAGES = f"p AS (SELECT {HOST} AS host, page_id, url, html, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)"
#: A word of a title as a whole word of a page, on every host.
GLOBALS = "g AS (SELECT DISTINCT host, w FROM p, w WHERE (length(w) >= 8) AND contains(html, w) AND regexp_matches(html, '\\b' || w || '\\b'))"
J05 = f"WITH {WORDS}, {PAGES}, {GLOBALS} SELECT host, 'word ' || lower(left(w, 2)) AS tech, CAST(least(50, 7 * count(*)) AS BIGINT) AS confidence, count(*) AS names FROM g GROUP BY ALL"
J06 = f"""WITH {WORDS}, f AS (SELECT length(w) % 6 AS form, CASE length(w) % 6 WHEN 0 THEN '(?=' || w || ')' WHEN 1 THEN '(' || w || ')\\1' WHEN 2 THEN '[' || w WHEN 3 THEN w || '(?<!x)' WHEN 4 THEN '^(?:' || w || ')+[0-9]{{1,3}}$' ELSE '\\b' || w || '\\b' END AS pattern FROM w),
t AS (SELECT form, TRY(regexp_matches('', pattern)) IS NOT NULL AS good FROM f) SELECT 'form ' || CAST(form AS VARCHAR) AS surface, count(*) FILTER (good) AS accepted, count(*) FILTER (NOT good) AS rejected FROM t GROUP BY form"""
J08 = f"""WITH {WORDS}, {PAGES}, {GLOBALS},
l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages),
c AS (SELECT DISTINCT host, page_id, unnest(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1))) AS k, unnest(range(len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')))) AS n FROM p),
s AS (SELECT host, page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM p),
hits(host, tech, rule, page_id, c, v) AS (
  SELECT host, 'language', 0, page_id, 100, CASE WHEN regexp_matches(lang, '^[a-zA-Z]{{2}}$') THEN left(lang, 1) || right(lang, 1) || '.x' END FROM p WHERE regexp_matches(lang, '^[a-zA-Z]{{2}}$')
  UNION ALL SELECT host, 'english', 1, page_id, 40, NULL FROM p WHERE contains(lower(lang), 'en')
  UNION ALL SELECT host, 'paged', 2, page_id, 60, NULL FROM c WHERE k = 'page'
  UNION ALL SELECT host, 'referred', 3, page_id, 30, NULL FROM c WHERE k = 'ref'
  UNION ALL SELECT host, 'titled', 4, page_id, 50, regexp_extract(title, '(?i)^([a-z]+) ([a-z]+)', 2) FROM p WHERE regexp_matches(title, '(?i)^([a-z]+) ([a-z]+)')
  UNION ALL SELECT host, 'titled', 5, page_id, 20, regexp_extract(title, '(?i)([a-z]+)[.]?$', 1) FROM p WHERE regexp_matches(title, '(?i)([a-z]+)[.]?$')
  UNION ALL SELECT host, 'articles', 7, page_id, 10, regexp_extract(h, '(?i)^/(th|de)', 1) FROM s WHERE regexp_matches(h, '(?i)^/(th|de)')
  UNION ALL SELECT host, 'bare', 8, page_id, 5, NULL FROM p
  UNION ALL SELECT host, 'link ' || lower(left(l.h, 3)), 100, page_id, 9, NULL FROM p, l WHERE contains(lower(html), lower('href="' || l.h || '"')) AND regexp_matches(html, '(?i)' || regexp_escape('href="' || l.h || '"'))),
js AS (SELECT host, 'word ' || lower(left(w, 2)) AS tech, least(50, 7 * count(*)) AS c FROM g GROUP BY ALL),
total AS (SELECT host, tech, sum(c) AS c FROM hits GROUP BY ALL UNION ALL SELECT host, tech, c FROM js),
-- the first version of each confidence, by order of rules and pages; the highest confidence wins
v AS (SELECT host, tech, arg_min(v, (-c, rule, page_id, v)) AS version FROM hits WHERE v <> '' GROUP BY ALL),
o AS (SELECT host, tech, v, min((rule, page_id)) AS f FROM hits WHERE v <> '' GROUP BY ALL)
SELECT host, tech, CAST(least(100, sum(c)) AS BIGINT) AS confidence, any_value(version) AS version, coalesce(any_value((SELECT string_agg(o.v, ',' ORDER BY o.f, o.v) FROM o WHERE o.host = total.host AND o.tech = total.tech AND o.v <> version)), '') AS other_versions
FROM total LEFT JOIN v USING (host, tech) GROUP BY host, tech"""

QUERIES = {"j05_globals": (j05_globals, J05), "j06_rejects": (j06_rejects, J06), "j08_technologies": (j08_technologies, J08)}
