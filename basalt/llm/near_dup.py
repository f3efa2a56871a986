"""MinHash near-duplicates by an inverted join of signature coordinates, confirmed on full shingle sets.

1. Every text gets its set of word shingles, a digest of the set and a signature of `coordinates` minima.
   Texts with equal sets form a class; its smallest doc_id stands for it in what follows.
2. A class is posted under each (coordinate, value). Two signatures that agree in `matches` coordinates or
   more share one of the coordinates - matches + 1 rarest of either, so only that prefix is kept; a class
   with fewer than `matches` shared coordinates is skipped.
3. For the classes left, shingles that no other of them has bound every similarity from above; what can't
   reach the threshold with anyone is dropped, exactly.
4. In each posting list every member is paired with the member of fewest own shingles. Pairs that agree in
   enough coordinates are confirmed on full sets; components follow.
5. Sets of lists with several components are posted once more, under their rarest shingles, and paired there
   across components. A group of many near copies so gives few pairs for each member, and no link between
   components is lost.

Signatures of 48 coordinates and 27 matches lose a pair at the threshold (0.85) with a chance near 1e-6;
everything after the signatures is exact.

Results: null or empty text, or text without words: an empty set, linked with nothing. Null doc_id: returned
with null component, kept. Rows that share a doc_id are one node. Empty table: empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.bloom import build
from basalt.llm.common import as_strings, small_batches, written
from basalt.llm.components import components
from basalt.llm.shingles import coordinate_minima, set_keys, shingle_sets

COORDINATES, MATCHES = 48, 27


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    """Coordinates in which two sets of this similarity agree at least, five standard deviations below the mean."""
    return int(coordinates * similarity - 5.2 * math.sqrt(coordinates * similarity * (1 - similarity)))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _signatures(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 4 << 20):
            sets, counts = shingle_sets(as_strings(batch.column(1)), width)
            keys = set_keys(sets, counts)
            minima = coordinate_minima(sets, counts, coordinates)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(minima.view(np.int32).ravel(), np.where(counts > 0, coordinates, 0), pa.int32())],
                names=["doc_id", "n_shingles", "key_a", "key_b", "signature"],
            )

    return run


def _full_sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(wanted.value.may_hold(ids.astype(np.int64).view(np.uint64))))
            for part in small_batches([batch], 1, 4 << 20):
                sets, counts = shingle_sets(as_strings(part.column(1)), width)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets.view(np.int64), counts, pa.int64())], names=["doc_id", "shingles"])

    return run


def _confirmed(matches: int, low: int, of: int):
    """Keep the pairs whose signatures agree often enough and whose full sets reach low / of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = [], [], []
            for side, out in ((2, left), (4, right)):
                offsets, values = batch.column(side).offsets.to_numpy(), batch.column(side).values.to_numpy(zero_copy_only=False)
                sig = batch.column(side + 1)
                out += [offsets, values, sig.values.to_numpy(zero_copy_only=False), sig.offsets.to_numpy()]
            for i in range(batch.num_rows):
                a, b = left[1][left[0][i] : left[0][i + 1]], right[1][right[0][i] : right[0][i + 1]]
                agree = np.count_nonzero(left[2][left[3][i] : left[3][i + 1]] == right[2][right[3][i] : right[3][i + 1]])
                ok = False
                if agree >= matches:
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok = of * both >= low * (len(a) + len(b) - both)
                keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _across(sets: DataFrame, low: int, of: int) -> DataFrame:
    """(a, b): all pairs of different components that may reach low / of; sets has doc_id, component, shingles.

    With the shingles of every set in one order, the rarest first, what a pair has in common starts at some
    shingle, with as much behind it in either set as the threshold asks for. So a set is posted under its
    rarest shingles only, and two rows of a list are paired only if their places leave enough behind. Rows of
    a list's smallest component, as a rule the large one, are not paired with each other.
    """
    n = F.size("shingles").cast("long")
    rows = sets.select("doc_id", "component", n.alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("x"), F.max("component").alias("y")).where("f > 1").select("s", "f", "x", (F.col("x") < F.col("y")).alias("mixed"))
    shared = rows.join(often, "s").groupBy("doc_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s", "x", "mixed"))).alias("shared"))
    reach = F.expr(f"n - CAST(ceil({low} * n / {of}D) AS BIGINT) + 1 - (n - size(shared))")
    posted = shared.withColumn("own", F.col("n") - F.size("shared")).withColumn("shared", F.slice("shared", F.lit(1), F.greatest(reach, F.lit(0)).cast("int")))
    posted = posted.select("doc_id", "component", "n", "own", F.posexplode("shared").alias("k", "z")).where("z.mixed")
    posted = written(posted.select("doc_id", "component", "n", (F.col("n") - F.col("own") - F.col("k")).alias("behind"), F.col("z.s").alias("s"), F.col("z.x").alias("x")), "rarest")
    # what no other row of its list can reach goes before rows are paired
    bounds = written(posted.groupBy("s").agg(F.min("n").alias("least_n"), F.max("behind").alias("most_behind")), "bounds")
    posted = posted.join(bounds, "s").where(F.lit(of + low) * F.least("behind", "most_behind") >= F.lit(low) * (F.col("n") + F.col("least_n"))).drop("least_n", "most_behind")
    p, q = posted.where("component <> x").alias("p"), posted.alias("q")
    once = (F.col("q.component") == F.col("q.x")) | (F.col("p.doc_id") < F.col("q.doc_id"))
    enough = F.lit(of + low) * F.least("p.behind", "q.behind") >= F.lit(low) * (F.col("p.n") + F.col("q.n"))
    pairs = p.join(q, (F.col("p.s") == F.col("q.s")) & (F.col("p.component") != F.col("q.component")) & once & enough)
    return pairs.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b"))


def links_of(docs: DataFrame, width: int = 3, low: int = 85, of: int = 100, coordinates: int = COORDINATES, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """(classes, components): every row with its set's digest; and (node, component) of linked class representatives.

    docs has doc_id (long) and text.
    """
    spark = docs.sparkSession
    rows = written(docs.mapInArrow(_signatures(width, coordinates), "doc_id long, n_shingles long, key_a long, key_b long, signature array<int>"), "signatures")
    key = ["n_shingles", "key_a", "key_b"]
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("doc_id"))
    reps = named.join(classes, [*key, "doc_id"]).dropDuplicates(["doc_id"])
    reps = written(reps.select("doc_id", "signature"), "classes")

    tokens = reps.select("doc_id", F.posexplode("signature").alias("at", "value")).select("doc_id", (F.col("at") * F.lit(1 << 32) + F.col("value")).alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tokens.join(often, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    # values of their own come first in the order of rarity, so they use up the prefix
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.lit(matches - 1)).getField("token")
    shared = shared.where(F.size("tokens") >= matches).select("doc_id", prefix.alias("prefix"))
    posted = written(shared.join(reps, "doc_id"), "posted")
    n = posted.count()

    bloom = spark.sparkContext.broadcast(build(posted.select("doc_id"), n))
    sets = docs.where("doc_id IS NOT NULL").mapInArrow(_full_sets(width, bloom), "doc_id long, shingles array<long>")
    sets = written(sets.join(posted, "doc_id").dropDuplicates(["doc_id"]), "sets")

    alone = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    alone = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    nodes = sets.join(alone, "doc_id", "left").select("doc_id", "prefix", F.size("shingles").cast("long").alias("n"), F.coalesce("own", F.lit(0)).alias("own"))
    # a pair shares at most n - own shingles, and its union has the other's own ones too
    nodes = nodes.where(F.lit(of) * (F.col("n") - F.col("own")) >= F.lit(low) * F.col("n"))
    postings = written(nodes.select("doc_id", "n", "own", F.explode("prefix").alias("token")), "postings")

    def possible(a: str, b: str) -> F.Column:
        most = F.least(F.col(f"{a}.n") - F.col(f"{a}.own"), F.col(f"{b}.n") - F.col(f"{b}.own"))
        least = F.greatest(F.col(f"{a}.n") + F.col(f"{b}.own"), F.col(f"{b}.n") + F.col(f"{a}.own"))
        return F.lit(of) * most >= F.lit(low) * least

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set"), F.col("signature").alias("a_sig")), "a")
        both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set"), F.col("signature").alias("b_sig")), "b")
        return written(both.select("a", "b", "a_set", "a_sig", "b_set", "b_sig").mapInArrow(_confirmed(matches, low, of), "a long, b long"), "confirmed")

    hubs = postings.groupBy("token").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("r"), "doc_id", "n", "own")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = written(hubs.select("token", F.col("h.doc_id").alias("doc_id"), F.col("h.n").alias("n"), F.col("h.own").alias("own")), "hubs")
    star = postings.alias("p").join(hubs.alias("h"), "token").where(F.col("p.doc_id") != F.col("h.doc_id")).where(possible("p", "h"))
    near = confirmed(star.select(F.least("p.doc_id", "h.doc_id").alias("a"), F.greatest("p.doc_id", "h.doc_id").alias("b")).distinct())
    known = written(components(near), "components")

    labelled = postings.join(known, postings.doc_id == known.node, "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    apart = labelled.join(mixed, "token", "left_semi").select("doc_id", "component").distinct()
    across = _across(apart.join(sets.select("doc_id", "shingles"), "doc_id"), low, of)
    rest = confirmed(across.distinct())
    return rows, known if rest.isEmpty() else components(near.unionByName(rest))


def near_duplicates(docs: DataFrame, width: int = 3, low: int = 85, of: int = 100, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of similarity low / of or more), kept."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, linked = links_of(plain, width, low, of, coordinates, matches)
    key = ["n_shingles", "key_a", "key_b"]
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("node"))
    classes = classes.join(linked, "node", "left").select(*key, F.coalesce("component", "node").alias("found"))
    out = rows.select("doc_id", *key).join(classes, key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
