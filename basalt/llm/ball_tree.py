"""Centroid clustering of integer vectors, exact, with ball trees that assign whole balls at once.

The vectors of a partition are dealt to blocks, and each block becomes one metric tree: a ball has a centre (the
floor of the mean), a radius, the number of its vectors and their componentwise integer sum. The trees are
written once, as rows of the shared folder, and read in every round. A round sends the centroids (their number
is a parameter) to the blocks. By the triangle inequality a centroid can be nearest to no vector of a ball if
its distance to the centre less the radius is more than the smallest distance of any centroid plus the radius;
a ball with one centroid left gives it count and sum as a whole, others are opened, and the vectors of leaves
are compared one by one. What leaves a block is one count and sum for a centroid, so a round shuffles
(blocks x centroids) rows at most and brings the centroids alone to the driver.

Bounds of the inequality are widened by a part in 10^9, so that rounding never decides; distances that decide or
that are returned are integers. Ties go to the smaller number.

Defined results: a vector is kept if it has exactly `width` components, none null, NaN or infinite. Components
become floor(scale * x), held within +-2^27 so that every distance and sum is a long. Repeated ids and rows are
vectors of their own; a null id counts as empty text for the choice of first centroids, among equal ids the
smaller vector comes first. Fewer kept vectors than centroids: as many centroids as vectors. No vectors: no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import record_batch, release_memory, remove_table, written

#: Vectors of a block, and of a leaf at most.
BLOCK, LEAF = 2048, 16
#: Components are held within this bound.
LIMIT = 1 << 27
#: Up to this size products are summed exactly in float64.
SMALL = 1 << 21
BALLS = "order binary, vectors binary, kind string, starts binary, ends binary, below binary, centres binary, radii binary, sums binary"


def integer_vectors(vectors: DataFrame, width: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of long) of the vectors that are kept."""
    x = F.col(vector_col).cast("array<double>")
    good = (F.size(x) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = F.transform(x, lambda e: F.greatest(F.lit(-LIMIT).cast("double"), F.least(F.lit(LIMIT).cast("double"), F.floor(e * F.lit(float(scale))).cast("double"))).cast("long"))
    return vectors.select(F.col(id_col).alias("vec_id"), F.when(good, held).alias("v")).where("v IS NOT NULL")


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest hexadecimal sha256 of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centroids, as integers."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1) if len(centroids) else np.zeros((len(points), 0), np.int64)


class Balls:
    """The tree of one block. Ball i has the vectors order[starts[i]:ends[i]] and, if it is no leaf, the balls below[i] and below[i] + 1."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, below: np.ndarray, centres: np.ndarray, radii: np.ndarray, sums: np.ndarray):
        self.vectors, self.order, self.starts, self.ends, self.below = vectors, order, starts, ends, below
        self.centres, self.radii, self.sums = centres, radii, sums
        self.opened = 0

    @classmethod
    def build(cls, vectors: np.ndarray) -> Balls:
        order, spans, below = np.arange(len(vectors)), [(0, len(vectors))], [0]
        centres, radii, sums = [], [], []
        i = 0
        while i < len(spans):
            a, b = spans[i]
            own = vectors[order[a:b]]
            total = own.sum(0)
            centre = total // (b - a)
            far = squared(own, centre[None])[:, 0]
            sums.append(total)
            centres.append(centre)
            radii.append(np.nextafter(np.sqrt(float(far.max())), np.inf))
            if b - a > LEAF and far.max() > 0:
                # along the line between the vector farthest from the centre and the one farthest from that
                one = own[far.argmax()]
                other = own[squared(own, one[None])[:, 0].argmax()]
                side = (own.astype(np.float64) @ (one - other).astype(np.float64)).argsort(kind="stable")
                order[a:b] = order[a:b][side]
                half = (a + b) // 2
                below[i] = len(spans)
                spans += [(a, half), (half, b)]
                below += [0, 0]
            i += 1
        starts, ends = np.array(spans, np.int64).T
        return cls(vectors, order, starts, ends, np.array(below), np.array(centres), np.array(radii), np.array(sums))

    def assign(self, centroids: np.ndarray, wanted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts and sums for every centroid; if wanted, also the cluster of each vector and its squared distance."""
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros_like(centroids)
        cluster, distance = np.full(len(self.vectors), -1), np.zeros(len(self.vectors), np.int64)
        at, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        leaves, allowed, self.opened = [], [], 0
        while len(at):
            d = np.sqrt(squared(self.centres[at], centroids).astype(np.float64))
            r = self.radii[at][:, None]
            most = np.where(open_, d + r, np.inf).min(1)[:, None]
            open_ = open_ & (d - r <= most * (1 + 1e-9) + 1e-6)
            alone = open_.sum(1) == 1
            whose = open_.argmax(1)
            np.add.at(counts, whose[alone], self.ends[at[alone]] - self.starts[at[alone]])
            np.add.at(sums, whose[alone], self.sums[at[alone]])
            if wanted:
                for i, c in zip(at[alone].tolist(), whose[alone].tolist(), strict=True):
                    rows = self.order[self.starts[i] : self.ends[i]]
                    cluster[rows] = c
                    distance[rows] = squared(self.vectors[rows], centroids[c : c + 1])[:, 0]
            leaf = ~alone & (self.below[at] == 0)
            leaves.append(at[leaf])
            allowed.append(open_[leaf])
            inner = ~alone & ~leaf
            at, open_ = np.repeat(self.below[at[inner]], 2), np.repeat(open_[inner], 2, 0)
            at[1::2] += 1
        leaf, allow = np.concatenate(leaves), np.concatenate(allowed)
        if len(leaf):
            size = self.ends[leaf] - self.starts[leaf]
            rows = np.concatenate([self.order[self.starts[i] : self.ends[i]] for i in leaf.tolist()])
            d = np.where(np.repeat(allow, size, 0), squared(self.vectors[rows], centroids), np.iinfo(np.int64).max)
            near = d.argmin(1)
            self.opened = len(rows)
            np.add.at(counts, near, 1)
            np.add.at(sums, near, self.vectors[rows])
            if wanted:
                cluster[rows], distance[rows] = near, d[np.arange(len(rows)), near]
        return counts, sums, cluster, distance

    def row(self) -> dict[str, object]:
        kind = next(t for t in ("int16", "int32", "int64") if np.abs(self.vectors).max(initial=0) <= np.iinfo(t).max)
        wide = {name: getattr(self, name).astype(np.int64).tobytes() for name in ("order", "starts", "ends", "below", "sums")}
        return wide | {"kind": kind, "vectors": self.vectors.astype(kind).tobytes(), "centres": self.centres.astype(np.int64).tobytes(), "radii": self.radii.tobytes()}

    @classmethod
    def from_row(cls, row: dict[str, object], width: int) -> Balls:
        own = {name: np.frombuffer(row[name], np.int64) for name in ("order", "starts", "ends", "below")}
        wide = {name: np.frombuffer(row[name], np.int64).reshape(-1, width) for name in ("centres", "sums")}
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, width).astype(np.int64)
        return cls(vectors, radii=np.frombuffer(row["radii"]), **own, **wide)


def trees(kept: DataFrame, width: int) -> DataFrame:
    """One row for a block of vectors of one partition: their ids (array) and the tree of their vectors."""
    schema = f"ids array<{kept.schema['vec_id'].dataType.simpleString()}>, {BALLS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            flat = part.column(1).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            row = Balls.build(flat.astype(np.int64)).row()
            ids = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), part.column(0).chunk(0))
            names = [x.split()[0] for x in BALLS.split(", ")]
            return record_batch({"ids": ids} | {n: pa.array([row[n]], pa.string() if n == "kind" else pa.binary()) for n in names})

        n = 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                held.append(batch.slice(a, BLOCK - n))
                a, n = a + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK:
                    yield block()
                    held.clear()
                    n = 0
        if n:
            yield block()
        release_memory()

    return kept.mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"} | {"ids": batch.column("ids")[i].values if "ids" in batch.schema.names else None}


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of every centroid's vectors; a centroid without vectors stays."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for row in _rows(batches):
            own = Balls.from_row(row, width).assign(centroids)
            counts, sums = counts + own[0], sums + own[1]
        has = np.flatnonzero(counts)
        ends = np.arange(len(has) + 1, dtype=np.int32) * width
        yield record_batch({"cluster": pa.array(has, pa.int32()), "n": pa.array(counts[has]), "total": pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[has].ravel()))})

    parts = blocks.drop("ids").mapInArrow(run, "cluster int, n long, total array<long>")
    means = [F.sum(F.col("total")[i].cast("decimal(28, 0)")).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *means).collect():
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, cluster, distance = Balls.from_row(row, width).assign(centroids, wanted=True)
            yield record_batch({"vec_id": row["ids"], "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})

    return blocks.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _of_cluster(values: list[str], kind: str) -> Column:
    """The value of the row's cluster, out of as many as there are centroids."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cluster") + 1).cast(kind)


def cluster(vectors: DataFrame, k: int, rounds: int, width: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    kept = integer_vectors(vectors, width, scale, id_col, vector_col)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        none = kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return none.where(F.lit(False))
    blocks = written(trees(kept, width), "balls")
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids)
    out = written(assigned(blocks, centroids), "clusters")
    remove_table(blocks)
    sums = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(30, 0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    most = np.iinfo(np.int64).max
    own = [str(min(sums.get(c, 0), most)) for c in range(len(centroids))]
    return out.withColumns({"cluster_inertia": _of_cluster(own, "long"), "inertia": F.lit(min(sum(sums.values()), most)).cast("long"), "centroid_sha256": _of_cluster(digests, "string")})
