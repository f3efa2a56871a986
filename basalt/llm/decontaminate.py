"""Benchmark decontamination by spaced seeds.

A seed is a mask over a few neighbouring words of which it reads some and ignores the others. Every mask at
every word of the test items gives a hash; the same at every word of the documents. A Bloom filter of fixed
size limit lets the documents' hashes pass that a test item may have; an equi-join with the items' hashes,
each taken once for a document, removes the false ones. Of the documents and items that meet, all places are
compared word by word, so that substituted words between hits do no harm. A document holds an item at a place
if `low` / `of` of the item's words or more are equal there.

The masks of MASKS find every item of six words or more of which a fifth is substituted, as far as tried (8
to 60 words). Items of five words or fewer have masks of their own in SHORT, which hold every case at the
default threshold; a mask is only applied to the documents if some item has its number of words.

Words: A-Z lower-cased, between ASCII white space, over whole texts. Items without words (null, empty or
white space alone) are ignored; null texts hold nothing. Repeated documents repeat their rows; items with
equal ids are told apart. Places that overlap are one row with the best number of equal words; a document
that holds an item in several places has a row for each. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.bloom import build
from basalt.llm.common import as_strings, ragged, record_batch, small_batches, written
from basalt.llm.shingles import PLACES, mix, word_hashes

#: 1: the word is read, 0: it is ignored. Each reads four words.
MASKS = ("1111", "11011", "101101", "1100101", "10010011", "110001001")
#: By number of words of an item, the masks that are applied besides; one word of five may be substituted.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("10111", "11101")}
LOW, OF = 80, 100


def seeds(words: np.ndarray, counts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one mask at all words of texts, and at which word; masks do not reach over the end of a text."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(len(words)) + span <= ends)
    n = len(words) - span + 1
    with np.errstate(over="ignore"):
        h = np.full(n, int(mask, 2), np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                h += words[k : k + n] * PLACES[k % len(PLACES)] ^ np.uint64(k)
        return mix(h, 17)[at], at


def _hits(masks: tuple[str, ...], bloom, sizes: dict[str, int] | None = None):
    """The hashes that each text has, once for each; masks of sizes only of the texts of that number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 2 << 20):
            words, counts = word_hashes(as_strings(batch.column(1)))
            starts = np.cumsum(counts) - counts
            for mask in masks:
                h, at = seeds(words, counts, mask)
                if bloom is not None:
                    hit = bloom.value.may_hold(h)
                    h, at = h[hit], at[hit]
                row = np.searchsorted(starts, at, side="right") - 1
                if sizes and mask in sizes:
                    fit = counts[row] == sizes[mask]
                    h, row = h[fit], row[fit]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                yield record_batch({"uid": batch.column(0).take(pa.array(row[new])), "seed": pa.array(h[new].view(np.int64))})

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = word_hashes(as_strings(batch.column(1)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64)))], names=["item", "words"])


def places(own: np.ndarray, item: np.ndarray, low: int, of: int) -> list[tuple[int, int, int]]:
    """(first, end, equal) in own of the runs of places where low / of of the item's words are equal."""
    order = np.argsort(item, kind="stable")
    first = np.searchsorted(item[order], own)
    times = np.searchsorted(item[order], own, side="right") - first
    shift = np.repeat(np.arange(len(own)), times) - order[ragged(first, times)] + len(item)
    equal = np.bincount(shift, minlength=len(own) + len(item) + 1)
    at = np.flatnonzero(of * equal >= low * len(item))
    if not len(at):
        return []
    a, b = np.maximum(at - len(item), 0), np.minimum(at, len(own))
    runs = np.flatnonzero(np.append(True, a[1:] >= b[:-1]))
    best = np.maximum.reduceat(equal[at], runs)
    return list(zip(a[runs].tolist(), b[np.append(runs[1:], len(at)) - 1].tolist(), best.tolist(), strict=True))


def _verified(low: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = word_hashes(as_strings(batch.column(1)))
            words, starts = words.view(np.int64), np.cumsum(counts) - counts
            docs, found = [], []
            for i, items in enumerate(batch.column(2)):
                own = words[starts[i] : starts[i] + counts[i]]
                for p in items:
                    theirs = p["words"].values.to_numpy()
                    for place in places(own, theirs, low, of):
                        docs.append(i)
                        found.append((p["item"].as_py(), *place, len(theirs)))
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            names = ("item", "first_word", "end_word", "equal_words", "item_words")
            yield record_batch({"row": batch.column(0).take(pa.array(docs, pa.int64())), **{name: pa.array(c, pa.int64()) for name, c in zip(names, cols, strict=True)}})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, low: int = LOW, of: int = OF, masks: tuple[str, ...] = MASKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, end_word (of the document), item_words, equal_words of every item found in a document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"])
    items = written(tests.select("item", "text").mapInArrow(_words, "item long, words array<long>").where(F.size("words") > 0), "items")
    lengths = {r[0] for r in items.select(F.size("words")).where(F.size("words") <= max(SHORT)).distinct().collect()}
    sizes = {mask: k for k in sorted(lengths) for mask in SHORT.get(k, ())}
    masks = (*masks, *sizes)
    known = written(tests.select("item", "text").mapInArrow(_hits(masks, None, sizes), "uid long, seed long").withColumnRenamed("uid", "item"), "seeds")
    keys = known.select("seed").distinct()
    bloom = spark.sparkContext.broadcast(build(keys, keys.count()))
    hits = rows.select("uid", "text").mapInArrow(_hits(masks, bloom), "uid long, seed long")
    met = written(hits.join(known, "seed").select("uid", "item").distinct().join(items, "item"), "met")
    holders = spark.sparkContext.broadcast(build(met.select("uid"), met.count()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holders.value.may_hold(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    wanted = met.groupBy("uid").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    texts = rows.select("uid", "doc_id", "text").mapInArrow(held, "uid long, doc_id long, text string").join(wanted, "uid")
    found = texts.select("doc_id", "text", "items").mapInArrow(_verified(low, of), "row long, item long, first_word long, end_word long, equal_words long, item_words long")
    return found.join(tests.select("item", "item_id"), "item").select(F.col("row").alias("doc_id"), "item_id", "first_word", "end_word", "item_words", "equal_words")
