"""Imports of modules resolved to the values that other modules export.

A relative import names several modules, its path with each of the known endings; the first of them that offers
the name counts. Candidates are exploded with their rank and joined by hash with what modules offer, which is
what they export themselves or pass on from another module; one aggregate takes the lowest rank. What is passed
on is then followed to where it is exported: each round doubles the length of the steps, so a chain of n modules
takes log2(n) rounds, and a round ends the loop when nothing moved. Names passed on in a circle have no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import intake
from basalt.sources.shared import cut

#: The endings of a path that are tried, in this order.
ENDINGS = ("", ".js", ".mjs", ".jsx", ".ts", ".tsx", "/index.js", "/index.mjs")


def _same(a: str, b: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def offered(exports: DataFrame, passed_on: DataFrame, scope: list[str]) -> DataFrame:
    """scope, module, name, own, value: what every module offers; own if it exports the name itself, which then counts."""
    own = exports.select(*scope, "module", "name", F.struct("ord", "value").alias("v"))
    other = passed_on.select(*scope, "module", "name", F.lit(None).cast(own.schema["v"].dataType).alias("v"))
    both = own.unionByName(other).groupBy(*scope, "module", "name").agg(F.min("v").alias("v"))
    return both.select(*scope, "module", "name", F.col("v").isNotNull().alias("own"), "v.value")


def linked(wants: DataFrame, offers: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """keys, to_module, to_name of wants (importer, specifier, imported) of which a candidate offers the name."""
    target = intake.resolve_specifier(F.col("importer"), F.col("specifier"))
    tried = F.array(*(F.concat("target", F.lit(e)) for e in ENDINGS))
    w = wants.withColumn("target", target).where("target IS NOT NULL").select(*dict.fromkeys([*scope, *keys, "imported"]), F.posexplode(tried).alias("rank", "candidate"))
    hit = w.alias("w").join(offers.alias("o"), _same("w", "o", scope) & (F.col("w.candidate") == F.col("o.module")) & (F.col("w.imported") == F.col("o.name")))
    first = hit.select(*(F.col(f"w.{k}").alias(k) for k in dict.fromkeys([*scope, *keys])), "w.rank", F.col("o.module").alias("to_module"), F.col("o.name").alias("to_name"))
    best = first.groupBy(*dict.fromkeys([*scope, *keys])).agg(F.min(F.struct("rank", "to_module", "to_name")).alias("b"))
    return best.select(*dict.fromkeys([*scope, *keys]), "b.to_module", "b.to_name")


def ends(passed_on: DataFrame, offers: DataFrame, scope: list[str]) -> DataFrame:
    """scope, module, name, to_module, to_name: where a name that is passed on is exported."""
    wants = passed_on.select(*scope, "module", "name", F.col("module").alias("importer"), "specifier", "imported")
    others = offers.where("NOT own").select(*scope, "module", "name")
    steps = linked(wants, offers, scope, ["module", "name"]).alias("w")
    steps = cut(steps.join(others.alias("o"), _same("w", "o", [*scope, "module", "name"]), "left_semi"), "steps")
    longest = steps.count()
    length = 1
    while length < max(2, longest * 2):
        a, b = steps.alias("a"), steps.alias("b")
        joined = a.join(b, _same("a", "b", scope) & (F.col("a.to_module") == F.col("b.module")) & (F.col("a.to_name") == F.col("b.name")), "left")
        go = F.col("b.module").isNotNull()
        moved = cut(joined.select(*(F.col(f"a.{k}").alias(k) for k in (*scope, "module", "name")), F.when(go, F.col("b.to_module")).otherwise(F.col("a.to_module")).alias("to_module"), F.when(go, F.col("b.to_name")).otherwise(F.col("a.to_name")).alias("to_name"), go.alias("go")), "steps")
        steps = moved.drop("go")
        if moved.where("go").isEmpty():
            break
        length *= 2
    return steps


def resolved(imports: DataFrame, exports: DataFrame, passed_on: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, importer, local, value of the imports (importer, local, imported, specifier) whose name leads to an exported value.

    exports: module, name, value, ord (of equal module and name the first counts). passed_on: module, name,
    specifier, imported. Imports of packages, of names that no candidate offers, and of names that end nowhere have
    no row. Of one importer's equal locals the last by `ord` (a column
    of imports; without it by specifier) that has a value counts.
    """
    by = list(scope)
    if passed_on is None:
        passed_on = exports.where(F.lit(False)).select(*by, "module", "name", F.col("name").alias("specifier"), F.col("name").alias("imported"))
    # written, so that joins with it can split a name that very many import
    offers = cut(offered(exports, passed_on, by), "offers")
    place = F.col("ord") if "ord" in imports.columns else F.lit(0)
    bindings = imports.select(*by, "importer", "local", "imported", "specifier", F.struct(place.alias("ord"), "specifier", "imported").alias("binding"))
    links = linked(bindings, offers, by, ["importer", "local", "binding"])
    end = ends(passed_on, offers, by)
    far = links.alias("l").join(end.alias("e"), _same("l", "e", by) & (F.col("l.to_module") == F.col("e.module")) & (F.col("l.to_name") == F.col("e.name")), "left")
    keys = [*by, "importer", "local", "binding"]
    at = far.select(*(F.col(f"l.{k}").alias(k) for k in keys), F.coalesce("e.to_module", "l.to_module").alias("module"), F.coalesce("e.to_name", "l.to_name").alias("name"))
    met = at.alias("p").join(offers.where("own").alias("v"), _same("p", "v", by) & (F.col("p.module") == F.col("v.module")) & (F.col("p.name") == F.col("v.name")))
    return met.groupBy(*(F.col(f"p.{k}").alias(k) for k in (*by, "importer", "local"))).agg(F.max_by("v.value", "p.binding").alias("value"))
