"""Quality rules: statistics of a text and a learned decision list, all in Spark expressions.

The list is grown by sequential covering on a bounded sample of labelled documents (MAX_LABELLED rows, the
smallest by a hash of doc_id): threshold conditions on ratios are added to a conjunction while they gain,
the conjunction is pruned on rows held back, and what it covers is set aside before the next. The result is
an ordered chain of conditions; the first that holds rejects the document. Two thirds of the sample grow
rules, one third prunes them; a rule must be right for MIN_PRECISION of the sample's rows it covers.

Null text counts as no words. Labels that are null, or whose documents are missing, are ignored; without
usable labels the list is empty and only the fixed limits reject. A document with labels of both kinds is not one
to be rejected. Other columns are kept or ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import SPACES, UPPER, WORD_GAP, written

MAX_LABELLED = 8192
MAX_RULES, MAX_CONDITIONS, CUTS = 8, 4, 16
MIN_PRECISION, MIN_COVERED = 0.95, 3
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Ratios that conditions may test, as expressions over the statistics.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_line": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated_words() -> str:
    """Words of q.words in windows found twice or more; every step is bound to a name, so that it is worked out once.

    Windows are sorted by hash, those equal to a neighbour give their places, and what they cover is added up.
    """
    windows = f"transform(sequence(1, size(q.words) - {WINDOW - 1}), i -> xxhash64(slice(q.words, i, {WINDOW})))"
    ordered = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    equal = "(j > 0 AND x.h = s[j - 1].h) OR (j + 1 < size(s) AND x.h = s[j + 1].h)"
    places = f"array_sort(filter(transform(s, (x, j) -> IF({equal}, x.i, NULL)), x -> x IS NOT NULL))"
    covered = f"aggregate({places}, struct(0L AS n, -{WINDOW} AS last), (a, x) -> struct(a.n + least({WINDOW}, x - a.last) AS n, x AS last), a -> a.n)"
    found = f"transform(array({ordered}), s -> {covered})[0]"
    return f"IF(size(q.words) < {WINDOW}, 0L, transform(array({windows}), h -> IF(size(array_distinct(h)) = size(h), 0L, {found}))[0])"


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other counts behind FEATURES.

    They come out of a generator of one row: no filter on them can move below and work them out twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    q = F.struct(
        text.alias("text"),
        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    taken = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_digits", "q"}
    out = docs.select(*(c for c in docs.columns if c not in taken), F.explode(F.array(q)).alias("q"))
    text, size = F.col("q.text"), F.length("q.text")
    counts = {
        "n_words": F.size("q.words"),
        "word_chars": _without(text, SPACES),
        "n_symbols": size - _without(text, SYMBOLS),
        "n_dup_lines": F.size("q.lines") - F.size(F.array_distinct("q.lines")),
        "n_repeat_words": F.expr(_repeated_words()),
        "n_lines": F.size("q.lines"),
        "n_upper": size - _without(text, UPPER),
        "n_bangs": size - _without(text, "!"),
        "n_digits": size - _without(text, "0123456789"),
    }
    one = F.array(F.struct(*(c.cast("long").alias(k) for k, c in counts.items())))
    return out.select(*(c for c in out.columns if c != "q"), F.inline(one))


#: The fixed limits: too few words, or too many of them in repeated windows.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

Rule = list[tuple[str, str, float]]


def _text(rule: Rule) -> str:
    return " AND ".join(f"({FEATURES[name]}) {op} {cut!r}D" for name, op, cut in rule)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """An ordered list of conjunctions that reject; labels has the id and quality (0: to be rejected)."""
    named = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("q_id"), (F.col("quality") == 0).alias("bad"))
    sample = named.groupBy("q_id").agg(F.min("bad").alias("bad")).orderBy(F.xxhash64("q_id"), "q_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "q_id")
    rows = statistics(rows).where(f"NOT ({BASE_FAILED})")
    rows = written(rows.select("bad", (F.pmod(F.xxhash64("q_id", F.lit(1)), F.lit(3)) == 0).alias("held"), *(F.expr(e).alias(k) for k, e in FEATURES.items())), "labelled")  # as many tasks as the documents have; the sample bounds the files
    at = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    # quantiles of the rows to be rejected and of the others, so that cuts lie where either has its rows
    cuts_row = rows.agg(*(F.percentile_approx(F.when(F.col("bad") == side, F.col(k)), at, 4 * max_labelled).alias(f"{k}_{int(side)}") for k in FEATURES for side in (False, True))).first()
    cuts = {k: sorted({*(cuts_row[f"{k}_0"] or []), *(cuts_row[f"{k}_1"] or [])}) for k in FEATURES}
    cuts = {k: v for k, v in cuts.items() if v}
    if not cuts:
        return []
    binned = rows.select("bad", "held", *(sum((F.col(k) > c).cast("int") for c in v).alias(k) for k, v in cuts.items()))
    cells = written(binned.groupBy("bad", "held", *cuts).agg(F.count(F.lit(1)).alias("w")).coalesce(1), "cells")

    def test(rule: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for name, op, k in rule:
            out = out & ((F.col(name) > k) if op == ">" else (F.col(name) <= k))
        return out

    def counts(part: DataFrame) -> tuple[int, int]:
        row = part.agg(F.sum(F.when(F.col("bad"), F.col("w"))), F.sum(F.when(~F.col("bad"), F.col("w")))).first()
        return row[0] or 0, row[1] or 0

    rules: list[list[tuple[str, str, int]]] = []
    left = cells
    while len(rules) < MAX_RULES:
        grow, hold = left.where("NOT held"), left.where("held")
        rule: list[tuple[str, str, int]] = []
        p0, n0 = counts(grow)
        while p0 and n0 and len(rule) < MAX_CONDITIONS:
            pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("bin")) for k in cuts))).alias("x")
            tally = {}
            for r in grow.where(test(rule)).select("bad", "w", pairs).groupBy("x.name", "x.bin", "bad").agg(F.sum("w").alias("w")).collect():
                tally[r["name"], r["bin"], r["bad"]] = r["w"]
            best = (0.0, None, 0, 0)
            for name, v in cuts.items():
                p = n = 0
                for k in range(len(v)):
                    p, n = p + tally.get((name, k, True), 0), n + tally.get((name, k, False), 0)
                    for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                        best = max(best, (_gain(a, b, p0, n0), (name, op, k), a, b), key=lambda x: x[0])
            if best[1] is None or best[0] <= 0:
                break
            rule.append(best[1])
            p0, n0 = best[2], best[3]
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            p, n = counts(hold.where(test(rule[:k])))
            scored.append(((p - n) / (p + n) if p + n else -1.0, k, p, n))
        _, k, p, n = max(scored)  # of equal ones the longest, which leaves more documents alone
        rule = rule[:k]
        more = counts(grow.where(test(rule)))
        p, n = p + more[0], n + more[1]
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left = left.where(~test(rule))
    return [[(name, op, cuts[name][k]) for name, op, k in rule] for rule in rules]


def verdict(rules: list[Rule]) -> Column:
    """The decision list: NULL where no rule rejects, else the number of the first that does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(F.expr(_text(rule)), F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the statistics, base_failed, rule (number of the rule that rejects, else null) and kept."""
    rules = learn(docs, labels, max_labelled, id_col, text_col)
    out = statistics(docs, text_col).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
