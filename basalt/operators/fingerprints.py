"""Technology fingerprints: a table of rules (tech, surface, key, value) against a table of signals (host, surface, key, value).

A rule's value is a pattern with tags behind `\\;` for version and confidence. Surfaces are header, cookie,
meta (looked up by key; of meta only `generator` counts), script_src and scripts and any other (patterns over the
whole value), and js (names of globals in `scripts` texts). Rules are cut to blocks of bounded size; each block is
sent to the workers once, as an automaton over what its patterns require, and one pass over the signals tries the
few patterns that can match. No join on surface, and no pair of a signal and a rule that can't meet.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators import patterns

DEFAULT_CONFIDENCE, JS_CEILING, CERTAIN = 100, 50, 100
#: Surfaces on which the rule's key names what is looked at.
KEYED = ("header", "cookie", "meta")
GENERATOR = "generator"
EVIDENCE = 200
#: A name of a global is looked for if it has this many characters; a plain word needs more.
LEAST_NAME, LEAST_WORD = 4, 8
#: Bytes of rules in a block, which a worker holds as one automaton.
BLOCK_BYTES = 8 << 20
HIT = "host string, tech string, js boolean, rule long, place long, confidence int, template string, groups array<string>, evidence string"


def dataset_rules(datasets: DataFrame, text: str = "text") -> DataFrame:
    """tech, surface, key, value, ord, categories of JSON data sets: an object of technologies with their fields for each surface."""
    shape = "map<string, struct<cats: array<int>, headers: map<string, string>, cookies: map<string, string>, meta: map<string, string>, scriptSrc: array<string>, scripts: array<string>, js: map<string, string>>>"
    each = datasets.select(F.posexplode(F.from_json(text, shape)).alias("t", "tech", "d"))

    def mapped(name: str, surface: str) -> Column:
        return F.transform(F.map_entries(f"d.{name}"), lambda e: F.struct(F.lit(surface).alias("surface"), (e.key if name == "js" else F.lower(e.key)).alias("key"), F.coalesce(e.value, F.lit("")).alias("value")))

    def listed(name: str, surface: str) -> Column:
        return F.transform(f"d.{name}", lambda v: F.struct(F.lit(surface).alias("surface"), F.lit(None).cast("string").alias("key"), v.alias("value")))

    none = F.array().cast("array<struct<surface: string, key: string, value: string>>")
    fields = [mapped("headers", "header"), mapped("cookies", "cookie"), mapped("meta", "meta"), listed("scriptSrc", "script_src"), listed("scripts", "scripts"), mapped("js", "js")]
    rules = each.select("t", "tech", F.coalesce("d.cats", F.array().cast("array<int>")).alias("categories"), F.posexplode(F.concat(*(F.coalesce(f, none) for f in fields))).alias("k", "r"))
    return rules.select("tech", "r.*", (F.col("t") * (1 << 20) + F.col("k")).cast("long").alias("ord"), "categories")


def parsed_rules(rules: DataFrame) -> DataFrame:
    """tech, surface, key, pattern, version, confidence of rules (tech, surface, key, value), and their other columns."""
    parts = F.split("value", "\\\\;")
    tags = F.slice(parts, F.lit(2), F.size(parts))

    def tag(name: str) -> Column:
        named = F.filter(tags, lambda t: F.startswith(t, F.lit(name + ":")))
        return F.try_element_at(F.transform(named, lambda t: F.substring(t, F.lit(len(name) + 2), F.length(t))), F.lit(-1))

    confidence = F.coalesce(tag("confidence").try_cast("int"), F.lit(DEFAULT_CONFIDENCE))
    rest = [c for c in rules.columns if c not in ("tech", "surface", "key", "value")]
    return rules.select("tech", "surface", "key", F.element_at(parts, 1).alias("pattern"), tag("version").alias("version"), confidence.alias("confidence"), *rest)


def distinctive(key: Column) -> Column:
    """Whether the name of a global is worth looking for: not short, and a plain word only if it is long."""
    return (F.length(key) >= LEAST_NAME) & ~(key.rlike("^[A-Za-z]+$") & (F.length(key) < LEAST_WORD))


def checked_rules(rules: DataFrame) -> DataFrame:
    """Parsed rules with `usable`: the pattern is one of RE2; a js rule needs a distinctive name and its pattern isn't used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [patterns.accepted(p) for p in batch.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], [*batch.schema.names, "re2"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema)
    return rules.mapInArrow(run, f"{fields}, re2 boolean").withColumn("usable", F.when(F.col("surface") == "js", F.coalesce(distinctive(F.col("key")), F.lit(False))).otherwise(F.col("re2"))).drop("re2")


def rejects(rules: DataFrame) -> DataFrame:
    """surface, accepted, rejected, passed_over (names of globals that aren't distinctive) of parsed rules."""
    js = F.col("surface") == "js"
    out = checked_rules(rules).groupBy("surface")
    return out.agg(F.count_if(F.col("usable")).alias("accepted"), F.count_if(~F.col("usable") & ~js).alias("rejected"), F.count_if(~F.col("usable") & js).alias("passed_over"))


def resolved_version(template: Column, groups: Column) -> Column:
    """The template with `\\N` replaced by groups; one `\\N?a:b` chooses by whether group N matched; null if nothing is left.

    Groups count from 1; a group that is absent, 0 included, is empty.
    """
    ternary = "\\\\([0-9])\\?([^:]+):(.*)$"

    def group(number: Column) -> Column:
        return F.when(number > 0, F.coalesce(F.try_element_at(groups, F.greatest(number, F.lit(1))), F.lit(""))).otherwise("")

    has = template.rlike(ternary)
    head = F.regexp_replace(template, ternary, "")
    tested = F.regexp_extract(template, ternary, 1).try_cast("int")
    chosen = F.when(group(tested) != "", F.regexp_extract(template, ternary, 2)).otherwise(F.regexp_extract(template, ternary, 3))
    whole = F.when(has, F.concat(head, chosen)).otherwise(template)
    # cut at the backslashes once, so that what a group brings in is never looked at again
    parts = F.split(whole, "\\\\")
    filled = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.when(p.rlike("^[0-9]"), F.concat(group(F.left(p, F.lit(1)).cast("int")), F.substring(p, F.lit(2), F.length(p)))).otherwise(F.concat(F.lit("\\"), p)))
    text = F.concat(F.element_at(parts, 1), F.array_join(filled, ""))
    return F.nullif(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""), F.lit(""))


class _Block:
    """Rules of one block, as a worker looks at them."""

    def __init__(self, rows: list[tuple]):
        self.rows = {row[0]: row for row in rows}
        by_key: dict[tuple[str, str], dict[int, str]] = {}
        by_surface: dict[str, dict[int, str]] = {}
        names: dict[str, list[int]] = {}
        for number, _, surface, key, pattern, *_rest in rows:
            if surface == "js":
                names.setdefault(key, []).append(number)
            elif surface in KEYED:
                by_key.setdefault((surface, key), {})[number] = pattern or ""
            else:
                by_surface.setdefault(surface, {})[number] = pattern or ""
        self.by_key = {k: patterns.PatternSet(v) for k, v in by_key.items()}
        self.by_surface = {k: patterns.PatternSet(v) for k, v in by_surface.items()}
        self.names = patterns.NameSet(names)

    def hits(self, batch: dict[str, list]) -> Iterator[tuple]:
        wanted: dict[int, list[int]] = {}
        sets: dict[int, patterns.PatternSet] = {}
        texts = list(batch["value"])
        for i, (surface, key, value) in enumerate(zip(batch["surface"], batch["key"], texts, strict=True)):
            if surface == "cookie":
                texts[i] = value = key or ""
            if value is None or surface == "header" and not value or surface == "meta" and key != GENERATOR:
                continue
            if surface == "scripts":
                for name in self.names.found(value):
                    for number in self.names.names[name]:
                        yield self._hit(batch, i, number, True, None, f"js: {name}"[:EVIDENCE])
            one = self.by_key.get((surface, key)) if surface in KEYED else self.by_surface.get(surface)
            for number in one.candidates(value) if one else ():
                wanted.setdefault(number, []).append(i)
                sets[number] = one
        for number, at in wanted.items():
            tried = sets[number].tried[number]
            for i, match in zip(at, tried.search(pa.array([texts[i] for i in at], pa.string())).to_pylist(), strict=True):
                if match is not None:
                    _, _, surface, key, *_rest = self.rows[number]
                    snippet = match["g0"] or ("<scripts match>" if surface == "scripts" else texts[i])
                    yield self._hit(batch, i, number, False, [match[f"g{k + 1}"] for k in range(tried.groups)], f"{key or surface}: {snippet}"[:EVIDENCE])

    def _hit(self, batch: dict[str, list], i: int, number: int, js: bool, groups: list[str] | None, evidence: str) -> tuple:
        _, tech, _, _, _, template, confidence = self.rows[number]
        return batch["host"][i], tech, js, number, batch["ord"][i], confidence, None if js else template, groups, evidence


_BLOCKS: dict[str, _Block] = {}


def _scan(sent: Broadcast, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BLOCKS:
            _BLOCKS.clear()  # a worker holds one block
            _BLOCKS[name] = _Block(sent.value)
        block = _BLOCKS[name]
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                rows = list(block.hits({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.slice(a, 200).columns, strict=True)}))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in HIT.split(", ")])
                del rows, columns
            del batch
        _release()

    return run


def _release() -> None:
    """Give a worker's freed memory back, so that workers which wait for their next task stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hits(signals: DataFrame, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """host, tech, js, rule, place, confidence, version, evidence of every rule that a signal meets. rules: of parsed_rules().

    rules may have `ord` (their order; else by their values), signals `ord`. Rules that RE2 rejects are left out
    (rejects() counts them).
    """
    if "ord" not in rules.columns:
        rules = rules.withColumn("ord", F.lit(0).cast("long"))
    if "ord" not in signals.columns:
        signals = signals.withColumn("ord", F.lit(0).cast("long"))
    spark = signals.sparkSession
    usable = checked_rules(rules).where("usable").select("ord", "tech", "surface", "key", "pattern", "version", "confidence").orderBy("ord", "tech", "surface", "key", "pattern", "version", "confidence")
    block: list[tuple] = []
    found: list[DataFrame] = []
    size = number = 0
    rows = signals.select("host", "surface", "key", "value", F.col("ord").cast("long").alias("ord"))

    def send() -> None:
        found.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast(list(block)), uuid.uuid4().hex), HIT))
        block.clear()

    for row in usable.toLocalIterator():  # a partition at a time; what is held is one block
        size += 64 + sum(len(x) for x in (row.tech, row.key, row.pattern, row.version) if x)
        block.append((number, *row[1:]))
        number += 1
        if size >= block_bytes:
            send()
            size = 0
    if block or not found:
        send()
    met = reduce(DataFrame.unionAll, found)
    return met.withColumn("version", F.when(~F.col("js"), resolved_version(F.col("template"), F.col("groups")))).drop("template", "groups")


def chosen_version(seen: Column) -> Column:
    """The version after (confidence, version) pairs in order: another version takes over if its own pattern's confidence is higher."""
    start = F.struct(F.lit(None).cast("string").alias("version"), F.lit(-1).alias("confidence"))
    step = lambda a, x: F.when(~x["version"].eqNullSafe(a["version"]) & (x["confidence"] > a["confidence"]), F.struct(x["version"].alias("version"), x["confidence"].alias("confidence"))).otherwise(a)
    return F.aggregate(seen, start, step, lambda a: a["version"])


def detections(signals: DataFrame, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """host, tech, confidence, version, other_versions, evidence.

    confidence: summed over all that a technology met, a global once for a host and all of them for JS_CEILING at
    most, everything for CERTAIN. version:
    of the rule of the highest confidence, the first of equal ones in order of rules and signals; the other
    versions follow in that order. evidence: distinct markers in order.
    """
    # one row for each distinct find of a rule on a host, before lists are made
    found = hits(signals, rules, block_bytes).groupBy("host", "tech", "js", "rule", "confidence", "version", "evidence").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    js = F.least(F.coalesce(F.sum(F.when(F.col("js"), F.col("confidence"))), F.lit(0)), F.lit(JS_CEILING))
    rest = F.coalesce(F.sum(F.when(~F.col("js"), F.col("confidence") * F.col("n"))), F.lit(0))
    seen = F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("rule", "place", "version", "confidence"))))
    marks = F.array_sort(F.collect_list(F.struct("js", "rule", "place", "evidence")))["evidence"]
    out = found.groupBy("host", "tech").agg(F.least(rest + js, F.lit(CERTAIN)).cast("long").alias("confidence"), seen.alias("seen"), marks.alias("marks"))
    out = out.withColumn("version", chosen_version(F.col("seen")))
    others = F.filter(F.array_distinct("seen.version"), lambda v: v != F.col("version"))
    return out.select("host", "tech", "confidence", "version", others.alias("other_versions"), F.array_distinct("marks").alias("evidence"))
