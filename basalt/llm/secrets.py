"""Secret scan in Spark expressions: fixed patterns, and character Markov models for what they miss.

Two first-order character models are counted from labelled samples, random strings and ordinary identifiers.
In each run of 20 or more token characters the stretches are found whose log-likelihood ratio is above RATIO
for each transition; each, widened to the next of DIVIDERS, is one more finding if it has 20 characters or
more and doesn't lie within a pattern match, so it may overlap one that is a part of it. The
models have one number for each pair of characters of a fixed alphabet, so they go into the plan as a
constant.

Spans are in code points, end exclusive. Null text counts as empty and has no findings; repeated rows repeat
their findings; an empty table gives an empty result. Columns of the input with the names of the result's
are replaced, others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the three kinds, the least characters of a finding and the group that is measured.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "markov")

#: Findings of a text that are gone through at a time.
BLOCK = 64
LEAST_RUN = 20
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: Characters that join a secret to other text, characters of a stretch at least, and the fall of its sum that ends it.
DIVIDERS, CORE, DROP = "/=_-", 10, 12
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Log-likelihood ratio for each transition from which a run counts as random.
RATIO = 0.6
#: Words that sample identifiers are put together from.
NOUNS = "user account order item price total count index value name list array table column row field key map set file path node tree graph edge page request response session client server handler manager service factory builder context config option setting parser writer reader stream buffer cache queue stack event listener message channel thread process worker task job schedule timer date time zone number string object class method function module package version update delete insert select create remove filter reduce transform convert format print error warning debug trace level color width height size length offset position start end begin finish next previous first last".split()


def sample(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples (token, random) by rule: digests in three alphabets, and joined words in three styles."""
    words = F.array(*(F.lit(w) for w in NOUNS))
    ids = spark.range(n)

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(NOUNS))) + 1).cast("int"))

    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.base64(F.unhex(digest))
    style = F.pmod(F.col("id"), F.lit(3))
    random = F.when(style == 0, F.substring(code, 1, 40)).when(style == 1, F.substring(F.regexp_replace(code, "[+/=]", ""), 1, 32)).otherwise(F.substring(digest, 1, 40))
    number = F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)).cast("string")).otherwise(F.lit(""))
    plain = F.when(style == 0, F.concat_ws("_", word(1), word(2), word(3), word(4))).when(style == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)))).otherwise(F.concat_ws("-", word(1), word(2), word(3), word(4)))
    return ids.select(random.alias("token"), F.lit(True).alias("random")).unionByName(ids.select(F.concat(plain, number).alias("token"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """For each pair of characters (first * SIZE + second) the log ratio of its chance in random strings and in identifiers."""
    pairs = samples.where("length(token) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("pair"))
    counts = {True: [1.0] * SIZE * SIZE, False: [1.0] * SIZE * SIZE}
    for r in pairs.groupBy("random", "pair").count().toLocalIterator():  # the alphabet bounds the rows that count
        a, b = (ALPHABET.find(c) + 1 for c in r["pair"])
        counts[r["random"]][a * SIZE + b] += r["count"]
    out = []
    for a in range(SIZE):
        rows = {k: v[a * SIZE : (a + 1) * SIZE] for k, v in counts.items()}
        sums = {k: sum(v) for k, v in rows.items()}
        out += [round(math.log(x / sums[True]) - math.log(y / sums[False]), 4) for x, y in zip(rows[True], rows[False], strict=True)]
    return out


def _found(pattern: str, keep: str = "true") -> str:
    """Spans of the leftmost matches of pattern in t that do not overlap: the text splits into what lies between them.

    Places are summed up within blocks of BLOCK matches and then over blocks, since a fold that grows an array
    copies it at every step.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
    step = f"struct(concat(a.spans, IF({keep}, array(struct(a.at + length(g[i]) AS s, a.at + length(g[i]) + length(m[i]) AS e, m[i] AS m)), array())) AS spans, a.at + length(g[i]) + length(m[i]) AS at)"
    empty = "CAST(array() AS array<struct<s: int, e: int, m: string>>)"
    fold = f"aggregate(sequence(j * {BLOCK}, least(size(m), j * {BLOCK} + {BLOCK}) - 1), struct({empty} AS spans, 0 AS at), (a, i) -> {step})"
    blocks = f"transform(sequence(0, CAST((size(m) - 1) DIV {BLOCK} AS INT)), j -> {fold})"
    starts = "aggregate(d, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x.at)))"
    moved = f"flatten(zip_with(d, slice({starts}, 1, size(d)), (x, o) -> transform(x.spans, z -> struct(z.s + o AS s, z.e + o AS e, z.m AS m))))"
    return f"transform(array(regexp_extract_all(t, '{p}', 0)), m -> IF(size(m) = 0, {empty}, transform(array(split(t, '{p}', -1)), g -> transform(array({blocks}), d -> {moved})[0])[0]))[0]"


def _stretches(model: list[float], ratio: float) -> str:
    """Spans of the random stretches of run x, widened to the next DIVIDERS.

    A stretch is where the sum of what the transitions have above ratio grows; it ends at its largest sum,
    once the sum has fallen by DROP below that.
    """
    table = "array(" + ",".join(f"{v}D" for v in model) + ")"
    codes = f"transform(split(x.m, ''), c -> instr('{ALPHABET}', c))"
    gains = f"zip_with(slice(k, 1, size(k) - 1), slice(k, 2, size(k) - 1), (p, q) -> {table}[p * {SIZE} + q] - {ratio}D)"
    spans = "CAST(array() AS array<struct<s: int, e: int>>)"
    done = f"IF(a.high > 0 AND a.e - a.s >= {CORE}, array(struct(a.s AS s, a.e AS e)), {spans})"
    start = f"struct({spans} AS spans, 0D AS sum, 0D AS high, 0 AS s, 0 AS e, 0 AS i)"
    grown = "struct(a.spans AS spans, a.sum + v AS sum, greatest(a.high, a.sum + v) AS high, a.s AS s, IF(a.sum + v > a.high, a.i + 2, a.e) AS e, a.i + 1 AS i)"
    again = f"struct(concat(a.spans, {done}) AS spans, 0D AS sum, 0D AS high, a.i + 1 AS s, a.i + 1 AS e, a.i + 1 AS i)"
    fold = f"aggregate(g, {start}, (a, v) -> IF(a.sum + v <= 0 OR a.sum + v < a.high - {DROP}, {again}, {grown}), a -> concat(a.spans, {done}))"
    found = f"flatten(transform(array({codes}), k -> flatten(transform(array({gains}), g -> {fold}))))"
    wide = f"struct(x.s + z.s - length(regexp_extract(substring(x.m, 1, z.s), '[^{DIVIDERS}]*$', 0)) AS s, x.s + z.e + length(regexp_extract(substring(x.m, z.e + 1), '^[^{DIVIDERS}]*', 0)) AS e)"
    return f"filter(array_distinct(transform({found}, z -> {wide})), z -> z.e - z.s >= {LEAST_RUN})"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def find(docs: DataFrame, model: list[float], text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_markov and findings (array of start, kind number, end), in order."""
    long_enough = f"length(regexp_replace(m[i], '^(?i)(password|passwd|secret|token|api_?key)[\"\\']?\\\\x20*[:=]\\\\x20*[\"\\']?', '')) >= {LEAST_ASSIGNED}"
    kinds = [_found(ASSIGN, long_enough), _found(ACCESS), _found(HEX)]
    taken = {"n_assign", "n_access", "n_hex", "n_markov", "findings"}
    one = ", ".join(f"{sql} AS k{i}" for i, sql in enumerate([*kinds, _found(RUN)]))
    rows = docs.select(*(c for c in docs.columns if c not in taken), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("*", F.explode(F.array(F.expr(f"struct({one})"))).alias("f"))
    tagged = "concat(" + ", ".join(f"transform(f.k{i}, x -> struct(x.s AS s, {i} AS kind, x.e AS e))" for i in range(3)) + ")"
    blocks = f"transform(IF(size(b) = 0, array(), sequence(0, CAST((size(b) - 1) DIV {BLOCK} AS INT))), j -> transform(array(slice(b, j * {BLOCK} + 1, {BLOCK})), y -> struct(y AS items, y[0].s AS low, array_max(transform(y, z -> z.e)) AS high))[0])"
    inside = "exists(c, y -> y.low <= x.s AND x.e <= y.high AND exists(y.items, z -> z.s <= x.s AND x.e <= z.e))"
    extra = f"transform(filter(flatten(transform(f.k3, x -> {_stretches(model, ratio)})), x -> NOT {inside}), x -> struct(x.s AS s, 3 AS kind, x.e AS e))"
    extra = _let("c", blocks, extra)
    both = _let("b", f"array_sort({tagged})", f"IF(size(f.k3) = 0, struct(b AS base, 0 AS more, b AS whole), {_let('w', extra, 'struct(b AS base, size(w) AS more, array_sort(concat(b, w)) AS whole)')})")
    result = F.array(
        F.struct(
            *(F.expr(f"CAST(size(f.k{i}) AS BIGINT)").alias(f"n_{KINDS[i]}") for i in range(3)),
            F.expr(both).alias("x"),
        )
    )
    out = rows.select(*(c for c in rows.columns if c not in ("t", "f")), F.inline(result))
    return out.withColumn("n_markov", F.col("x.more").cast("long")).withColumn("base_findings", F.col("x.base")).withColumn("findings", F.col("x.whole")).drop("x")


def spans_text(findings: str) -> Column:
    """kind:start:end of all findings, joined by commas."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({findings}, x -> concat({names}[x.kind], ':', CAST(x.s AS STRING), ':', CAST(x.e AS STRING))), ',')")


def redact(text_col: str = "text", findings: str = "findings", mark: str = "[redacted]") -> Column:
    """The text with every finding replaced; of findings that overlap, all characters.

    The text is cut at blocks of BLOCK findings first and each block's part at its findings, so that no cut walks
    the whole text and no fold copies more than its block.
    """
    blocks = f"transform(sequence(0, CAST((size({findings}) - 1) DIV {BLOCK} AS INT)), j -> slice({findings}, j * {BLOCK} + 1, {BLOCK}))"
    ends = "aggregate(b, array(0), (a, y) -> concat(a, array(greatest(element_at(a, -1), array_max(transform(y, x -> x.e))))))"
    step = f"IF(x.s >= a.at, struct(concat(a.out, substring(t, a.at - h[i] + 1, x.s - a.at), '{mark}') AS out, greatest(a.at, x.e) AS at), struct(a.out AS out, greatest(a.at, x.e) AS at))"
    part = _let("t", f"substring({text_col}, h[i] + 1, h[i + 1] - h[i])", f"aggregate(y, struct('' AS out, h[i] AS at), (a, x) -> {step}, a -> a.out)")
    whole = f"concat(array_join(transform(b, (y, i) -> {part}), ''), substring({text_col}, element_at(h, -1) + 1))"
    return F.expr(f"IF(size({findings}) > 0, {_let('b', blocks, _let('h', ends, whole))}, {text_col})")


def scan(docs: DataFrame, samples: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """find() with models trained on labelled samples (token, random); by default those of sample()."""
    return find(docs, train(sample(docs.sparkSession) if samples is None else samples), text_col)
