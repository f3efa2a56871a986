"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (one to three code points of the lower-cased text), weighted by their share of
the text's n-grams and by inverse document frequency over all learning documents. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (MAX_SAMPLE documents, the
smallest by a hash of doc_id), one fifth of which is held back to calibrate a temperature. Texts of any
length are read whole.

Null text, or text without a letter: `und` with score 0. Nothing to learn from: `und` with score 0 for all.
Rows whose text or lang is null are not learned from. Repeated rows are repeated. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import as_strings, record_batch, small_batches, written

BITS = 16
SIZE = 1 << BITS
MAX_SAMPLE, EPOCHS = 4096, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 1e-3, 1e-4, 30.0


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts, one text after the other, and the number of each (a text has at least one)."""
    parts, counts = [], []
    for text in pc.utf8_lower(texts).to_pylist():
        c = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
        own = [c, c[:-1] * np.uint32(0x9E3779B1) + c[1:]]
        own.append(own[1][:-1] * np.uint32(0x85EBCA77) + c[2:])
        grams = np.concatenate([(x * np.uint32(0xC2B2AE3D) + np.uint32(k)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS) for k, x in enumerate(own)])
        parts.append(grams)
        counts.append(len(grams))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.int32), np.array(counts, np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each n-gram, and of all under SIZE."""
    df, docs = np.zeros(SIZE, np.int64), 0
    for batch in small_batches(batches, 0, 2 << 20):
        grams, counts = ngrams(as_strings(batch.column(0)))
        for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True):
            seen = np.zeros(SIZE, bool)
            seen[grams[a:b]] = True
            df += seen
        docs += len(counts)
    at = np.flatnonzero(df)
    yield record_batch({"gram": pa.array(np.append(at, SIZE).astype(np.int32)), "n": pa.array(np.append(df[at], docs))})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1, 2 << 20):
        grams, counts = ngrams(as_strings(batch.column(1)))
        ids, shares, sizes = [], [], []
        for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True):
            i, n = np.unique(grams[a:b], return_counts=True)
            ids.append(i)
            shares.append((n / (b - a)).astype(np.float32))
            sizes.append(len(i))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(shares)))],
            names=["key", "lang", "ids", "shares"],
        )


class Leader:
    """Follow the regularised leader, per coordinate, for softmax regression."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _fit(idf: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.frombuffer(idf, np.float32)
        rows = []
        for batch in batches:
            keys, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                ids, shares = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                rows.append((keys[i], langs[i], ids, (shares * weight[ids] * SCALE).astype(np.float64)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        names = sorted({r[1] for r in rows})
        if not names:
            return
        number = {x: k for k, x in enumerate(names)}
        held = rows[::5] if len(rows) >= 25 else rows
        model = Leader(len(names))
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                if i % 5 or len(rows) < 25:
                    model.learn(rows[i][2], rows[i][3], number[rows[i][1]])
        w = model.weights(slice(None))
        logits = np.array([r[3] @ w[r[2]] for r in held])
        truth = np.array([number[r[1]] for r in held])
        loss = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.05, 20, 61)}
        best = min(loss, key=loss.get)
        yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([(w * weight[:, None] * SCALE).astype(np.float32).tobytes()], pa.binary()), pa.array([float(best)])], names=["langs", "weights", "temperature"])

    return run


def train(rows: DataFrame, max_sample: int = MAX_SAMPLE) -> tuple[list[str], bytes, float] | None:
    """(languages, weights, temperature) from rows (doc_id, text, lang)."""
    known = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sums = known.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # SIZE + 1 rows at most
    total = np.zeros(SIZE + 1, np.int64)
    total[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    total, docs = total[:SIZE], int(total[SIZE])
    if not docs:
        return None
    idf = np.where(total > 0, np.log((docs + 1) / (total + 1)) + 1, 0).astype(np.float32)
    keyed = known.withColumn("key", F.xxhash64("doc_id", F.lit(3)))
    chosen = keyed.select("key").distinct().orderBy("key").limit(max_sample)
    sample = keyed.join(F.broadcast(chosen), "key").select("key", "text", "lang").limit(max_sample)
    features = written(sample.mapInArrow(_features, "key long, lang string, ids array<int>, shares array<float>"), "features")
    row = features.coalesce(1).mapInArrow(_fit(idf.tobytes()), "langs array<string>, weights binary, temperature double").first()
    return (list(row.langs), bytes(row.weights), row.temperature) if row else None


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 2 << 20):
            texts = as_strings(batch.column(1))
            n = len(texts)
            names, scores = np.full(n, "und", object), np.zeros(n)
            readable = pc.match_substring_regex(texts, "\\p{L}").to_numpy(zero_copy_only=False)
            if model.value is not None and readable.any():
                langs, weights, temperature = model.value
                w = np.frombuffer(weights, np.float32).reshape(SIZE, len(langs))
                grams, counts = ngrams(texts)
                starts = np.cumsum(counts) - counts
                logits = np.stack([np.add.reduceat(w[grams, k].astype(np.float64), starts) for k in range(len(langs))], 1)
                p = softmax(logits / counts[:, None] / temperature)
                best = p.argmax(1)
                names[readable], scores[readable] = np.array(langs, object)[best[readable]], p.max(1)[readable]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], bytes, float] | None) -> DataFrame:
    """doc_id, lang_pred, score of rows (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


