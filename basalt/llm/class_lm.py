"""Class-based bigram language model with classes from exchange clustering (Brown et al.; Kneser and Ney).

Counts cover all learning documents; every learned word gets a class by exchange.

1. The UNITS most frequent words, ENDINGS groups of the other words' endings and the end of a text are moved
   between CLASSES classes, one unit after the other, as long as the likelihood of the class bigrams grows.
   The bigram counts of these units have a fixed size, so one task can do this.
2. Every other word is moved once: its occurrences are gathered by word over all documents, each with the
   classes before and after it, and it goes to the class in which these are most likely.
3. Class bigrams are counted anew with the words' own classes, of all words.

log10 probability of a text: for each token, class given the class before it (the end stands before the
first) and word given class, both with add-one smoothing. A word that was not learned has the class of its
ending and is one more word there.

Counting and scoring: counts and classes of the HEAD most frequent words go to all tasks (a fixed bound); those
of other words come by an exact join on the word's 64-bit hash, so results don't depend on the HEAD. Words: A-Z lower-cased, between ASCII white space,
whole texts; null text counts as empty and has the end alone. Repeated rows are learned from and scored each.
An empty table gives an empty result; if no document is learned from, all counts are 0 and all classes alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import as_strings, blobs, record_batch, release_memory, small_batches, written
from basalt.llm.shingles import mix, words_and_endings

UNITS, ENDINGS, CLASSES, SWEEPS = 768, 255, 64, 6
HEAD = 1 << 19
#: Words, and tokens, of a bucket on average; rows of a bucket that are held before they are merged.
BUCKET, TOKENS, FOLD = 1 << 17, 4 << 20, 1 << 20
#: The hash that stands for the end of a text.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def _group(endings: np.ndarray) -> np.ndarray:
    return (mix(endings.astype(np.uint64), 21) % np.uint64(ENDINGS)).astype(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending groups of all tokens, the end after each text included, and the number of each text."""
    words, counts, endings = words_and_endings(texts)
    ends = np.cumsum(counts)
    return np.insert(words, ends, END), np.insert(_group(endings), ends, 0), counts + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(words)
        first = np.flatnonzero(np.append(True, np.diff(words[order]) != 0))
        return words[order][first], np.add.reduceat(n[order], first)

    for batch in small_batches(batches, 0, 4 << 20):
        words, n = np.unique(_tokens(as_strings(batch.column(0)))[0], return_counts=True)
        held.append((words, n.astype(np.int64)))
        if len(held) == 8:
            held = [merged()]
            if len(held[0][0]) > 2_000_000:
                yield record_batch({"word": pa.array(held[0][0].view(np.int64)), "n": pa.array(held[0][1])})
                held = []
    if held:
        words, n = merged()
        yield record_batch({"word": pa.array(words.view(np.int64)), "n": pa.array(n)})


class Lookup:
    """Sorted keys with a value each; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


def _units(words: np.ndarray, groups: np.ndarray, frequent: Lookup) -> np.ndarray:
    """0: the end, then the ending groups, then frequent words."""
    unit = frequent(words)
    unit = np.where(unit >= 0, unit + 1 + ENDINGS, groups + 1)
    unit[words == END] = 0
    return unit


def _pairs(frequent):
    total = 1 + ENDINGS + UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, np.int64)
        for batch in small_batches(batches, 0, 4 << 20):
            words, groups, _ = _tokens(as_strings(batch.column(0)))
            unit = _units(words, groups, frequent.value)
            before = np.concatenate([[0], unit[:-1]])  # each text ends with the end
            sums += np.bincount(before * total + unit, minlength=total * total)
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of units, by moving one unit after the other to the class of largest likelihood. Unit 0 stays alone in class 0."""
    n = len(bigrams)
    weight = bigrams.sum(0)
    order = [u for u in np.argsort(-weight, kind="stable") if u]
    label = np.zeros(n, np.int64)
    for k, u in enumerate(order):
        label[u] = 1 + k % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    left, right = (bigrams.T @ one), (bigrams @ one)  # of each unit: counts after, and before, each class
    table = one.T @ bigrams @ one
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = label[u], bigrams[u, u]
            into, out = left[u].copy(), right[u].copy()
            into[a] -= own
            out[a] -= own
            rest = table.copy()
            rest[:, a] -= into
            rest[a, :] -= out
            rest[a, a] -= own
            # likelihood gained by joining each class: changed cells, and the classes' totals
            col, row = _xlogx(rest + into[:, None]) - _xlogx(rest), _xlogx(rest + out[None, :]) - _xlogx(rest)
            gain = col.sum(0) + row.sum(1) - np.diagonal(col) - np.diagonal(row)
            diagonal = np.diagonal(rest)
            gain += _xlogx(diagonal + into + out + own) - _xlogx(diagonal)
            ins, outs = rest.sum(0), rest.sum(1)
            gain -= _xlogx(ins + into.sum() + own) - _xlogx(ins) + _xlogx(outs + out.sum() + own) - _xlogx(outs)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            rest[:, b] += into
            rest[b, :] += out
            rest[b, b] += own
            table = rest
            if b != a:
                moved += 1
                label[u] = b
                left[:, a] -= bigrams[u]
                left[:, b] += bigrams[u]
                right[:, a] -= bigrams[:, u]
                right[:, b] += bigrams[:, u]
        if not moved:
            break
    return label


def _fitted(bigrams: np.ndarray, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units, and the counts of class bigrams."""
    label = exchange(bigrams, classes, sweeps)
    one = np.zeros((len(label), classes))
    one[np.arange(len(label)), label] = 1
    return label, one.T @ bigrams @ one


def _clustered(classes: int, sweeps: int):
    total = 1 + ENDINGS + UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams = np.zeros(total * total)
        for batch in batches:
            bigrams[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
        label, table = _fitted(bigrams.reshape(total, total), classes, sweeps)
        yield record_batch({"label": pa.array([label.tobytes()], pa.binary()), "table": pa.array([table.tobytes()], pa.binary())})

    return run


def _occurrences(model, classes: int, buckets: int):
    """Of every word: how often it has which classes before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, label = model.value
        for batch in small_batches(batches, 0, 4 << 20):
            words, groups, _ = _tokens(as_strings(batch.column(0)))
            k = label[_units(words, groups, frequent)]
            code = np.concatenate([[0], k[:-1]]) * classes + np.append(k[1:], 0)
            at = np.flatnonzero(words != END)
            at = at[np.lexsort((code[at], words[at]))]
            words, code = words[at], code[at]
            first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (code[1:] != code[:-1]))) if len(words) else at
            n = np.diff(np.append(first, len(words)))
            words, code = words[first], code[first]
            bucket = ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            yield record_batch(blobs(bucket, word=words.astype("<u8"), code=code.astype("<u2"), n=n.astype("<i4")))

    return run


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """word, code, n in order of word and code, each pair of these once."""
    word, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((code, word))
    word, code, n = word[order], code[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (code[1:] != code[:-1]))) if len(word) else np.zeros(0, np.int64)
    return [word[first], code[first], np.add.reduceat(n, first) if len(word) else n]


def _folded(batches: Iterator[pa.RecordBatch], most: int = FOLD) -> list[np.ndarray]:
    """word, code, n of a bucket, merged whenever twice as many rows are held as differ, so that a frequent word never has more than its pairs of classes."""
    held, rows, limit = [[np.zeros(0, "<u8"), np.zeros(0, "<u2"), np.zeros(0, np.int64)]], 0, most
    for batch in batches:
        for word, code, n in zip(*(batch.column(name) for name in ("word", "code", "n")), strict=True):
            held.append([np.frombuffer(x.as_py(), kind) for x, kind in zip((word, code, n), ("<u8", "<u2", "<i4"), strict=True)])
            rows += len(held[-1][0])
            if rows >= limit:
                held = [_merged(held)]
                rows = len(held[0][0])
                limit = max(most, 2 * rows)
    return _merged(held)


def _moved(model, classes: int, piece: int = 16_384):
    """Number and class of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, label, before, after = model.value
        word, code, n = _folded(batches)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        ends, a = np.append(first[1:], len(word)), 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, first[a] + piece)))
            rows = slice(first[a], ends[b - 1])
            gain = before[code[rows] // classes]
            gain += after[code[rows] % classes]
            gain *= n[rows, None]
            best = np.argmax(np.add.reduceat(gain, first[a:b] - first[a]), axis=1)
            own = frequent(word[first[a:b]])
            best = np.where(own >= 0, label[own + 1 + ENDINGS], best)
            yield record_batch({"word": pa.array(word[first[a:b]].view(np.int64)), "n": pa.array(np.add.reduceat(n[rows], first[a:b] - first[a])), "class": pa.array(best.astype(np.int32))})
            a = b
        release_memory()

    return run


def _classes_of(words: np.ndarray, groups: np.ndarray, found: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The classes found, for those that are -1 the ending's; 0 of the end."""
    return np.where(words == END, 0, np.where(found >= 0, found, label[groups + 1]))


def _steps(head, classes: int):
    """Class bigrams: of the head's words by number; where one of both words is beyond it, that word stands instead of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * classes, np.int64)
        for batch in small_batches(batches, 0, 4 << 20):
            words, _, _ = _tokens(as_strings(batch.column(0)))
            at = head.value(words)
            k = np.where(words == END, 0, np.where(at >= 0, at % classes, -1))
            first, last = np.concatenate([[0], k[:-1]]), k  # each text ends with the end
            known = (first >= 0) & (last >= 0)
            sums += np.bincount(first[known] * classes + last[known], minlength=classes * classes)
            rest = np.flatnonzero(~known)
            if len(rest):
                words = words.view(np.int64)
                before = np.concatenate([[0], words[:-1]])[rest]
                yield record_batch(
                    {
                        "first": pa.array(first[rest], mask=first[rest] < 0),
                        "last": pa.array(last[rest], mask=last[rest] < 0),
                        "before": pa.array(before, mask=first[rest] >= 0),
                        "after": pa.array(words[rest], mask=last[rest] >= 0),
                        "n": pa.array(np.ones(len(rest), np.int64)),
                    }
                )
        at = np.flatnonzero(sums)
        none = pa.nulls(len(at), pa.int64())
        yield record_batch({"first": pa.array(at // classes), "last": pa.array(at % classes), "before": none, "after": none, "n": pa.array(sums[at])})

    return run


def _counted_steps(texts: DataFrame, vocabulary: DataFrame, head, classes: int) -> DataFrame:
    """first, last, n: class bigrams of the texts, with the classes of all words in the vocabulary."""
    rows = written(texts.mapInArrow(_steps(head, classes), "first long, last long, before long, after long, n long"), "steps")
    for side, word in (("first", "before"), ("last", "after")):
        named = vocabulary.select(F.col("word").alias(word), F.col("class").cast("long").alias("found"))
        looked_up = rows.where(F.col(word).isNotNull()).join(named, word).withColumn(side, F.col("found")).withColumn(word, F.lit(None).cast("long")).drop("found")
        rows = rows.where(F.col(word).isNull()).unionByName(looked_up)
    return rows.groupBy("first", "last").agg(F.sum("n").alias("n"))


def _tails(head):
    """The rows with a number each and their distinct words that the head lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 1, 4 << 20):
            words, _, counts = _tokens(as_strings(batch.column(1)))
            doc = np.repeat(np.arange(len(counts)), counts)
            at = np.flatnonzero((head.value(words) < 0) & (words != END))
            at = at[np.lexsort((words[at], doc[at]))]
            at = at[np.append(True, (np.diff(words[at]) != 0) | (np.diff(doc[at]) != 0))] if len(at) else at
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(counts)))]).astype(np.int32)
            yield record_batch({"row": pa.array(row + np.arange(batch.num_rows)), "doc_id": batch.column(0), "text": batch.column(1), "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[at].view(np.int64)))})
            row += batch.num_rows

    return run


def _scored(model, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, label, step, size = model.value
        for batch in small_batches(batches, 1, 4 << 20):
            words, groups, counts = _tokens(as_strings(batch.column(1)))
            more = batch.column(2).flatten()
            tail = Lookup(more.field("word").to_numpy(zero_copy_only=False).view(np.uint64), more.field("value").to_numpy(zero_copy_only=False))
            at = head(words)
            lacking = at < 0
            at[lacking] = tail(words[lacking])
            n = np.where(at >= 0, at // classes, 0)
            k = _classes_of(words, groups, np.where(at >= 0, at % classes, -1), label)
            known = np.log10(n + 1.0)
            own = step[np.concatenate([[0], k[:-1]]), k] + known - size[k]
            starts = np.cumsum(counts) - counts
            yield record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array(counts),
                    "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)),
                    "known": pa.array(np.add.reduceat(known, starts)),
                    "score": pa.array(np.add.reduceat(own, starts)),
                }
            )

    return run


def _head(vocabulary: DataFrame, most: int) -> DataFrame:
    """The most frequent words, `most` at most: all of the frequencies from one on, so that nothing is sorted."""
    step = F.floor(F.log2("n") * 16)
    least, held = np.inf, 0
    for r in sorted(vocabulary.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # some hundred steps at most
        held += r["count"]
        if held > most:
            break
        least = r.step
    return vocabulary.where(step >= F.lit(float(least)))


def score(docs: DataFrame, learn: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text), learned from learn (doc_id, text)."""
    share = docs.sparkSession.sparkContext.broadcast
    texts, total = learn.select("text"), 1 + ENDINGS + UNITS
    counted = written(texts.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    end = F.col("word") == F.lit(int(END.astype(np.int64)))
    size, tokens, ends = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0))).first()
    chosen = counted.where(~end).orderBy(F.desc("n"), "word").limit(UNITS).toArrow().column("word").to_numpy().view(np.uint64)
    frequent = Lookup(chosen, np.arange(len(chosen)))
    pairs = written(texts.mapInArrow(_pairs(share(frequent)), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")  # total * total rows at most
    fitted = pairs.coalesce(1).mapInArrow(_clustered(classes, sweeps), "label binary, table binary").first()
    if fitted is None:
        label, table = _fitted(np.zeros((total, total)), classes, 1)
    else:
        label, table = np.frombuffer(fitted.label, np.int64), np.frombuffer(fitted.table).reshape(classes, classes)

    # how much likelier each class is beside another than by itself; the end's class takes no words
    rows = np.log((table + 1) / (table.sum(1, keepdims=True) + classes))
    alone = np.log((table.sum(0) + 1) / (table.sum() + classes))
    before, after = rows - alone, (rows - alone).T.copy()
    before[:, 0] = after[:, 0] = -np.inf
    buckets = max(8, -(-size // BUCKET), -(-tokens // TOKENS))  # the vocabulary grows more slowly than what is counted of it
    seen = texts.mapInArrow(_occurrences(share((frequent, label)), classes, buckets), "bucket int, word binary, code binary, n binary")
    moved = seen.repartition(buckets, "bucket").mapInArrow(_moved(share((frequent, label, before, after)), classes), "word long, n long, class int")
    vocabulary = written(moved.select("word", "class", (F.col("n") * classes + F.col("class")).alias("value"), "n"), "classes")

    top = _head(vocabulary, HEAD).select("word", "value").toArrow()  # HEAD bounds it
    head = Lookup(np.append(top.column("word").to_numpy().view(np.uint64), END), np.append(top.column("value").to_numpy(), ends * classes))
    steps = np.ones((classes, classes))
    for r in _counted_steps(texts, vocabulary, share(head), classes).collect():  # a row for each pair of classes at most
        steps[r["first"], r["last"]] += r.n
    room = np.ones(classes)
    room[0] += ends + 1
    for r in vocabulary.groupBy("class").agg((F.sum("n") + F.count(F.lit(1))).alias("n")).collect():  # a row for each class at most
        room[r["class"]] += r.n
    model = share((head, label, np.log10(steps / steps.sum(1, keepdims=True)), np.log10(room)))

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(named.mapInArrow(_tails(share(head)), "row long, doc_id long, text string, words array<long>"), "rows")
    tail = rows.select("row", F.explode("words").alias("word")).join(vocabulary.select("word", "value"), "word")
    tail = tail.groupBy("row").agg(F.collect_list(F.struct("word", "value")).alias("tail"))
    out = rows.select("row", "doc_id", "text").join(tail, "row", "left").select("doc_id", "text", F.coalesce("tail", F.array().cast("array<struct<word: bigint, value: bigint>>")).alias("tail"))
    out = out.mapInArrow(_scored(model, classes), "doc_id long, n_tokens long, n_known long, known double, score double")
    least = float(np.log10(tokens + size + 1.0))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("known") - F.col("n_tokens") * F.lit(least)).alias("base_score"), "score")
