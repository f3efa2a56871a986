"""Repeated byte strings: every byte covered by a string of `length` bytes that also starts anywhere else.

1. Anchors. Of every window of `length` bytes the smallest hash of its `grain`-byte strings is an anchor, so
   two equal windows have equal anchors at equal places. An anchor's context is all the windows around it.
   Anchors are counted over all documents; those that occur once end here.
2. Classes. Equal contexts of an anchor are one class with a count. A class that occurs twice or more is
   repeated as a whole.
3. Suffix arrays. Anchors with different contexts send one text for each class to shards of bounded size:
   all of an anchor to one shard, or, if they are too many, to several. Each shard sorts its suffixes by
   Larsson-Sadakane refinement and gets common prefixes by Kasai's rule, run over all contexts side by side.
   Neighbours with `length` bytes in common that start at different places mark repeated windows.
4. Anchors over several shards: each sends sorted fingerprints of its windows, cut by value into buckets;
   binary search in the merged bucket finds those that other shards have as well.
5. The marked windows of each document are joined with its text, united and cut out.

Null text counts as empty. Rows of equal doc_id are separate documents; a repeated row repeats all its
windows. Matches never cross documents. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.bloom import build
from basalt.llm.common import as_strings, ragged, release_memory, small_batches, written
from basalt.llm.shingles import mix, powers, text_bytes

LENGTH, GRAIN = 200, 120
#: Contexts of one anchor in one shard, and bytes of contexts in a shard on average.
SHARD_CLASSES, SHARD_BYTES = 4096, 2_000_000


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for every i, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(np.arange(256, dtype=np.uint64), 9)[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def anchors(data: np.ndarray, cuts: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, ...]:
    """(document, position in data, left, right, anchor hash, context hash) of all anchors of the documents data[cuts[d]:cuts[d+1]]."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    with np.errstate(over="ignore"):
        total, down, n = _prefix_hash(data), powers(len(data) + 1)[1], len(data)
        h = mix((total[grain:] - total[:-grain]) * down[: n - grain + 1])
        ends = np.repeat(cuts[1:], np.diff(cuts))
        at = np.arange(n)
        h[at[: n - grain + 1] + grain > ends[: n - grain + 1]] = ~np.uint64(0)
        wide = length - grain + 1
        low = _sliding(h, wide, np.minimum)
        low[at[: len(low)] + length > ends[: len(low)]] = 0
        pad = np.zeros(wide - 1, np.uint64)
        high = _sliding(np.concatenate([pad, low, pad]), wide, np.maximum)
        pos = np.flatnonzero((high == h) & (high > 0))
        doc = np.searchsorted(cuts, pos, side="right") - 1
        first, last = np.maximum(cuts[doc], pos - (wide - 1)), np.minimum(cuts[doc + 1], pos + length)
        left, right = pos - first, last - pos
        context = mix((total[last] - total[first]) * down[first] + (left * 4096 + right).astype(np.uint64), 3)
    return doc, pos, left, right, h[pos], context


def _anchor_rows(length: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            data, cuts = text_bytes(as_strings(batch.column(1)))
            doc, pos, left, right, anchor, context = anchors(data, cuts, length, grain)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array((pos - cuts[doc]).astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))],
                names=["uid", "pos", "left", "right", "anchor", "context"],
            )

    return run


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array of data, by Larsson-Sadakane refinement from an order by eight bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    del key
    rank = np.empty(n, np.int64)  # of a group: the place of its first
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    have = 8
    while have < 2 * n:
        # groups of one are in place; the others are sorted by the rank of what follows
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        part = order[slots]
        behind = part + have
        follow = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        keys = rank[part] * (n + 1) + follow
        by = np.argsort(keys)
        keys = keys[by]
        order[slots] = part[by]
        split = np.ones(len(slots), bool)
        split[1:] = keys[1:] != keys[:-1]
        new[slots] = split
        rank[order[slots]] = np.maximum.accumulate(np.where(split, slots, 0))
        have *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the bytes it has in common with the one before it, up to most.

    Kasai's rule: at the next place of a text the common prefix is shorter by one at most. All pieces
    data[start : start + length] are gone through side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int16), np.full(most, -1, np.int16)])
    found, h = np.zeros(n, np.int16), np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max()) if len(lengths) else 0):
        lanes = np.flatnonzero(lengths > step)
        p = starts[lanes] + step
        q = before[p]
        run = np.maximum(h[lanes] - 1, 0)
        run[q < 0] = 0
        going = np.flatnonzero((q >= 0) & (run < most))
        while len(going):
            same = (padded[p[going] + run[going]] == padded[q[going] + run[going]]) & (p[going] + run[going] < n) & (q[going] + run[going] < n)
            going = going[same]
            run[going] += 1
            going = going[run[going] < most]
        h[lanes] = run
        found[p] = run
    return found[order]


def repeated_starts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, place: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Of every byte of the pieces, whether a window that is repeated starts there.

    place: a number of each piece's first byte in its document, the same for the same place; many: pieces that occur more than once.
    """
    n = len(data)
    owner = np.repeat(np.arange(len(starts)), lengths)
    offset = np.arange(n) - starts[owner]
    whole = offset + length <= lengths[owner]
    order = suffix_order(data)
    group = np.cumsum(common_prefixes(data, order, starts, lengths, length) < length) - 1
    fit = whole[order]
    at, group = order[fit], group[fit]
    out = np.zeros(n, bool)
    if len(at):
        with np.errstate(over="ignore"):
            where = place[owner[at]] + offset[at].astype(np.uint64)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        mixed = (np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)) | np.maximum.reduceat(many[owner[at]], first)
        out[at] = np.repeat(mixed, np.diff(np.append(first, len(at))))
    return out


CONTEXTS = "anchor long, context long, copies long, classes long, part long, left int, place long, body binary"
RANGES = "anchor long, context long, first int, last int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (uid, text, wanted contexts) the bytes of each context."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, cuts = text_bytes(as_strings(batch.column(1)))
        lists = batch.column(2)
        wanted, of = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        pos, left, right = (wanted.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "left", "right"))
        seeds = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 11)
        with np.errstate(over="ignore"):
            place = seeds[of] + (pos - left).astype(np.uint64)
        first, length = cuts[of] + pos - left, left + right
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        bodies = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[ragged(first, length)].tobytes())])
        plain = [wanted.field(k).cast(pa.int64()) for k in ("anchor", "context", "copies", "classes", "part")]
        yield pa.RecordBatch.from_arrays([*plain, pa.array(left.astype(np.int32)), pa.array(place.view(np.int64)), bodies], names=[x.split()[0] for x in CONTEXTS.split(", ")])


def _pieces(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, cuts = text_bytes(bodies)
    return data, cuts[:-1], np.diff(cuts)


def _ranges(table: pa.Table | pa.RecordBatch, hit: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """Runs of marked starts, relative to the anchor."""
    at = np.flatnonzero(hit)
    owner = np.repeat(np.arange(len(starts)), lengths)[at]
    cut = np.append(True, (np.diff(at) != 1) | (np.diff(owner) != 0)) if len(at) else np.zeros(0, bool)
    first, last = at[cut], at[np.append(cut[1:], True)] if len(at) else at
    who = owner[cut]
    zero = starts[who] + table.column("left").to_numpy(zero_copy_only=False)[who] if len(who) else who
    rows = pa.array(who)
    return [table.column("anchor").take(rows), table.column("context").take(rows), pa.array((first - zero).astype(np.int32)), pa.array((last - zero).astype(np.int32))]


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _shard(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, starts, lengths = _pieces(table.column("body"))
        place = table.column("place").to_numpy(zero_copy_only=False).view(np.uint64)
        many = table.column("copies").to_numpy(zero_copy_only=False) > 1
        hit = repeated_starts(data, starts, lengths, place, many, length)
        yield pa.RecordBatch.from_arrays(_ranges(table, hit, starts, lengths), names=["anchor", "context", "first", "last"])
        release_memory()

    return run


def _fingerprints(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the contexts, a 64-bit hash; and the start of the window in the pieces."""
    data, starts, lengths = _pieces(_one(table.column("body")))
    at = ragged(starts, np.maximum(lengths - length + 1, 0))
    with np.errstate(over="ignore"):
        total = _prefix_hash(data)
        return mix((total[at + length] - total[at]) * powers(len(data) + 1)[1][at], 4), at, starts, lengths


def _low_and_high(prints: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the smallest and the largest place of each."""
    order = np.argsort(prints)
    prints, places = prints[order], places[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    if not len(first):
        return prints, places, places
    return prints[first], np.minimum.reduceat(places, first), np.maximum.reduceat(places, first)


def _cut(length: int, shard_classes: int):
    def run(table: pa.Table) -> pa.Table:
        prints, at, starts, lengths = _fingerprints(table, length)
        owner = np.repeat(np.arange(len(starts)), np.maximum(lengths - length + 1, 0))
        with np.errstate(over="ignore"):
            place = table.column("place").to_numpy().view(np.uint64)[owner] + (at - starts[owner]).astype(np.uint64)
        twice = (table.column("copies").to_numpy() > 1)[owner]  # windows of several places at once
        prints, low, high = _low_and_high(np.concatenate([prints, prints[twice]]), np.concatenate([place, ~place[twice]]))
        buckets = -(-table.column("classes")[0].as_py() // shard_classes)
        bucket = (prints >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, *(x[edges[b] : edges[b + 1]].tobytes() for x in (prints, low, high))) for b in range(buckets) if edges[b] < edges[b + 1]]
        one = {k: pa.array([table.column(k)[0].as_py()] * len(rows), pa.int64()) for k in ("anchor", "part")}
        return pa.table({**one, "bucket": pa.array([r[0] for r in rows], pa.int64()), **{k: pa.array([r[i] for r in rows], pa.binary()) for i, k in ((1, "prints"), (2, "low"), (3, "high"))}})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Fingerprints of two or more places in the bucket's shards, found by binary search for each shard."""
    own, low, high = ([np.frombuffer(x.as_py(), np.uint64) for x in table.column(k)] for k in ("prints", "low", "high"))
    both = [np.concatenate(x) for x in (own, low, high)]
    prints, least, most = _low_and_high(np.concatenate([both[0], both[0]]), np.concatenate([both[1], both[2]]))
    several = prints[least != most]
    found = []
    for x in own:
        spot = np.searchsorted(several, x)
        hit = np.zeros(len(x), bool)
        inside = spot < len(several)
        hit[inside] = several[spot[inside]] == x[inside]
        found.append(x[hit].tobytes())
    return pa.table({"anchor": table.column("anchor"), "part": table.column("part"), "found": pa.array(found, pa.binary())})


def _marked(length: int):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["anchor", "context", "first", "last"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], names=names)
        prints, at, starts, lengths = _fingerprints(table, length)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in found.column("found"))]))
        hit = np.zeros(int(lengths.sum()), bool)
        if len(known):
            spot = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            hit[at[known[spot] == prints]] = True
        table = pa.table({k: _one(table.column(k)) for k in ("anchor", "context", "left")})
        return pa.table(_ranges(table, hit, starts, lengths), names=names)

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(1))
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            first, last = (lists.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for i in range(batch.num_rows):
                body = texts[i].as_py().encode()
                a, b = (offsets[i], offsets[i + 1]) if valid[i] else (0, 0)
                change = np.zeros(len(body) + 1, np.int64)
                np.add.at(change, first[a:b], 1)
                np.add.at(change, last[a:b] + length, -1)
                covered = np.cumsum(change)[:-1] > 0
                spans = int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(len(covered) > 0 and covered[0])
                kept = np.frombuffer(body, np.uint8)[~covered].tobytes() if b > a else body
                out.append((len(body), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def repeated_ranges(rows: DataFrame, length: int = LENGTH, grain: int = GRAIN, shard_classes: int = SHARD_CLASSES) -> DataFrame:
    """(uid, first, last): ranges of byte places of documents (uid, text) at which repeated windows start."""
    spark = rows.sparkSession
    found = written(rows.mapInArrow(_anchor_rows(length, grain), "uid long, pos int, left short, right short, anchor long, context long"), "anchors")
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("context") < F.max("context")).alias("mixed")).where("n > 1")
    often = written(often.select("anchor", "mixed"), "often")  # so that the join can split hot anchors
    seen = written(found.join(often, "anchor"), "repeated")
    whole = F.struct((F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right") - F.lit(length)).alias("last"))
    plain = seen.where("NOT mixed").select("uid", whole.alias("r"))

    classes = seen.where("mixed").groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("uid", "pos", "left", "right")).alias("one"))
    classes = written(classes, "counted")
    sizes = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"))
    classes = classes.join(written(sizes, "sizes"), "anchor").withColumn("part", F.expr(f"pmod(context, ceil(classes / {shard_classes}))"))
    classes = written(classes, "classes")
    n = classes.count()
    wanted = classes.groupBy("one.uid").agg(F.collect_list(F.struct("one.pos", "one.left", "one.right", "anchor", "context", "copies", "classes", "part")).alias("wanted"))
    bloom = spark.sparkContext.broadcast(build(classes.select("one.uid"), n))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.value.may_hold(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    texts = rows.mapInArrow(holders, "uid long, text string").join(wanted, "uid").select("uid", "text", "wanted")
    contexts = written(texts.mapInArrow(_contexts, CONTEXTS), "contexts")
    shards = max(1, -(-n * (2 * length - grain) // SHARD_BYTES))
    ranges = contexts.repartition(shards, "anchor", "part").mapInArrow(_shard(length), RANGES)
    hot = contexts.where(F.col("classes") > shard_classes)
    if not hot.isEmpty():
        cut = hot.groupBy("anchor", "part").applyInArrow(_cut(length, shard_classes), "anchor long, part long, bucket long, prints binary, low binary, high binary")
        both = cut.groupBy("anchor", "bucket").applyInArrow(_merge, "anchor long, part long, found binary")
        ranges = ranges.unionByName(hot.groupBy("anchor", "part").cogroup(both.groupBy("anchor", "part")).applyInArrow(_marked(length), RANGES))
    ranges = ranges.groupBy("anchor", "context").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = classes.select("anchor", "context", "copies").join(ranges, ["anchor", "context"], "left")
    mixed = seen.where("mixed").join(ranges, ["anchor", "context"])
    several = mixed.where("copies > 1").select("uid", whole.alias("r"))
    single = mixed.where("copies = 1").select("uid", "pos", F.explode("ranges").alias("x"))
    single = single.select("uid", F.struct((F.col("pos") + F.col("x.first")).alias("first"), (F.col("pos") + F.col("x.last")).alias("last")).alias("r"))
    return plain.unionByName(several).unionByName(single).select("uid", "r.*").where("first <= last")


def remove_repeats(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, shard_classes: int = SHARD_CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text of every document (kept_text: replacement characters where a cut falls inside one)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(rows.select("uid", "text"), length, grain, shard_classes)
    by_doc = ranges.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    out = rows.join(by_doc, "uid", "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
