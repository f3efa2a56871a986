"""Byte-level BPE encoding and decoding of whole texts, by a file of token ranks.

A text is cut by the splitting pattern; each distinct piece of a few megabytes of text is encoded once. The
merges of a piece are found in a segment tree over its byte positions: a leaf holds the rank of the pair that
starts there, an inner node the leftmost smallest rank below it. The root names the next merge; it takes the
right part out of the chain of live parts and updates three leaves (the merged pair, its left neighbour's pair,
and the part that is gone), each in as many steps as the tree has levels. Pieces of similar length go through
their merges side by side in numpy arrays; few or long ones take a tree of plain lists.

Defined results: a null text is the empty text and has no ids; a null id, repeated ids and repeated rows stay
rows of their own, in any order; very long texts are cut where a space follows other text, which is always a
border of pieces, so memory follows the longest text and not the partition; columns besides the two that are
named are not read. Ids that the vocabulary does not have decode to nothing, as do null lists and null ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import as_strings, ragged, record_batch, release_memory, small_batches

#: Fixed value: the pattern that the array splitter below implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text worked on at a time.
PART = 2 << 20
#: Cells of the trees that go through their merges side by side.
CELLS = 1 << 17
#: A group of fewer pieces takes trees of lists.
FEW = 12
NONE = 1 << 40
_LOADED: dict[str, Vocabulary] = {}
_CLASSES: list[np.ndarray] = []
SPACE, LETTER, DIGIT, OTHER = range(4)


class Vocabulary:
    """Tokens by rank, and the rank that two neighbouring tokens merge to."""

    def __init__(self, path: str, keep: int = 400_000):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.keep, size = keep, max(ranks.values(), default=-1) + 1
        names = [b""] * size
        for token, rank in ranks.items():
            names[rank] = token
        self.names = pa.array(names, pa.binary())
        self.known, self.known_ids = pa.array(list(ranks), pa.binary()), np.fromiter(ranks.values(), np.int32, len(ranks))
        self.lengths = np.fromiter(map(len, names), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer(b"".join(names), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(a << 32) | b: rank for token, rank in ranks.items() for cut in range(1, len(token)) if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None}
        self.pairs = pairs
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self._hash(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.forget()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merged pairs; NONE where they don't merge."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        at = np.flatnonzero((found != key) & (found >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[at]]
            hit = found == key[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (found >= 0)]
        return out

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.rows.update(zip(pieces, range(len(self.rows), len(self.rows) + len(pieces)), strict=True))
        self.ids.append(ids)
        self.ends.append(self.ends[-1][-1] + np.cumsum(lengths))


def vocabulary(path: str) -> Vocabulary:
    """One for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _merged_one(piece: bytes, words: Vocabulary) -> list[int]:
    """The ids of one piece, with a tree of lists."""
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    pairs, part = words.pairs, [int(words.of_byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE * size] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get((part[i] << 32) | part[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        rank = pairs.get((part[i] << 32) | part[j]) if j < n else None
        return NONE * size if rank is None else rank * size + i

    while n > 1 and tree[1] < NONE * size:
        rank, i = divmod(tree[1], size)
        gone = after[i]
        part[i], after[i] = rank, after[gone]
        if after[gone] < n:
            before[after[gone]] = i
        put(gone, NONE * size)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(part[i])
        i = after[i]
    return out


def _merged_many(data: np.ndarray, lengths: np.ndarray, size: int, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces of up to `size` bytes (a power of two), merged side by side."""
    n, levels, width = len(lengths), size.bit_length() - 1, size + 1
    place = np.arange(size)
    inside = place < lengths[:, None]
    part = np.zeros((n, width), np.int32)
    part[:, :size][inside] = words.of_byte[data]
    after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, size), (n, width)).copy()
    live = np.zeros((n, width), bool)
    live[:, :size] = inside
    tree = np.full((n, 2 * size), NONE * size, np.int64)
    starts = inside.copy()
    starts[np.arange(n), lengths - 1] = False
    row, at = np.nonzero(starts)
    tree[row, size + at] = words.rank_of(part[row, at], part[row, at + 1]) * size + at
    for k in range(levels - 1, -1, -1):
        a, b = 1 << k, 2 << k
        tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
    part, after, before, live, tree = part.ravel(), after.ravel(), before.ravel(), live.ravel(), tree.ravel()
    rows = np.arange(n)
    while True:
        root = tree[rows * 2 * size + 1]
        rows = rows[root < NONE * size]
        if not len(rows):
            break
        root = root[root < NONE * size]
        rank, i = root >> levels, root & (size - 1)
        base, node = rows * width, rows * 2 * size
        own = base + i
        gone = after[own]
        follows = after[base + gone]
        part[own], after[own] = rank, follows
        live[base + gone] = False
        ends = lengths[rows]
        before[base + np.minimum(follows, size)] = i
        precedes = before[own]
        right = np.where(follows < ends, words.rank_of(part[own], part[base + np.minimum(follows, size)]), NONE)
        left = np.where(precedes >= 0, words.rank_of(part[base + np.maximum(precedes, 0)], part[own]), NONE)
        tree[node + size + gone] = NONE * size
        tree[node + size + i] = np.where(right < NONE, right * size + i, NONE * size)
        has = precedes >= 0
        tree[(node + size + precedes)[has]] = np.where(left < NONE, left * size + precedes, NONE * size)[has]
        up = np.concatenate([size + gone, size + i, size + np.maximum(precedes, 0)])
        node = np.concatenate([node, node, node])
        for _ in range(levels):
            up >>= 1
            below = node + 2 * up
            tree[node + up] = np.minimum(tree[below], tree[below + 1])
    live = live.reshape(n, width)
    return part.reshape(n, width)[live], live.sum(1)


def _merged(pieces: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the distinct pieces in order, and the number of ids of each."""
    whole = pc.index_in(pieces, value_set=words.known)
    single = whole.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    counts, found = np.ones(len(pieces), np.int64), [(np.flatnonzero(single), words.known_ids[pc.drop_null(whole).to_numpy()])]
    open_ = np.flatnonzero(~single)
    level = np.ceil(np.log2(np.maximum(lengths[open_], 2))).astype(np.int64)
    for k in np.unique(level):
        at = open_[level == k]
        size = 1 << int(k)
        step = max(1, CELLS // (2 * size))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            if len(some) < FEW:
                lists = [_merged_one(x, words) for x in pieces.take(pa.array(some)).to_pylist()]
                counts[some] = [len(x) for x in lists]
                found.append((some, np.fromiter((i for x in lists for i in x), np.int32)))
            else:
                taken = pieces.take(pa.array(some))
                data = np.frombuffer(b"".join(taken.to_pylist()), np.uint8)
                ids, counts[some] = _merged_many(data, lengths[some], size, words)
                found.append((some, ids))
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for at, ids in found:
        out[ragged(ends[at] - counts[at], counts[at])] = ids
    return out, counts


def _classes() -> np.ndarray:
    """The class of every code point, by the pattern's own classes."""
    if not _CLASSES:
        import regex

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text, table = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
            table[[ord(c) for c in regex.findall(pattern, text)]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def _cut(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of UTF-8 texts begin (bytes), and the number of pieces of each text; texts end at `ends`."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(wide)])
    first = np.searchsorted(offset, np.concatenate([[0], ends]))
    n, kind = len(points), _classes()[points]
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    change = np.append(True, kind[1:] != kind[:-1]) | opens[:n]
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], n)
    spaces = kind[begin] == SPACE
    start = np.zeros(n + 4, bool)
    start[begin] = True
    inner = spaces & ~opens[end]  # white space with other text behind it in the same text
    last = end[inner] - 1
    start[last] = True
    start[end[inner][points[last] == 0x20]] = False
    # contractions: a lone apostrophe that begins a piece, with small letters behind it
    lone = np.flatnonzero((points[begin] == 0x27) & (end - begin == 1) & start[begin] & ~opens[end])
    lone = lone[kind[end[lone]] == LETTER]
    if len(lone):
        at, stop = end[lone], end[lone + 1]
        one = points[at]
        two = np.where(at + 1 < stop, points[np.minimum(at + 1, n - 1)], 0)
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(long_, 2, 0))
        start[at[taken > 0]] = False
        more = (taken > 0) & (at + taken < stop)
        start[(at + taken)[more]] = True
    pieces = np.flatnonzero(start[:n])
    return offset[pieces], np.diff(np.searchsorted(pieces, first))


def _cut_by(data: bytes, ends: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _cut for any pattern, with the pieces' lengths; text that it doesn't match belongs to no piece."""
    import regex

    found, starts, lengths, counts, begin = regex.compile(pattern), [], [], [], 0
    for end in ends.tolist():
        text, at, place, n = data[begin:end].decode("utf-8"), begin, 0, 0
        for m in found.finditer(text):
            at += len(text[place : m.start()].encode())
            piece = len(m.group().encode())
            if piece:
                starts.append(at)
                lengths.append(piece)
                n += 1
            at, place = at + piece, m.end()
        counts.append(n)
        begin = end
    return np.array(starts, np.int64), np.array(lengths, np.int64), np.array(counts, np.int64)


def encode_texts(texts: pa.Array, words: Vocabulary, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """All ids (int32) of some texts, and the number of ids of each text."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    data = b"".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    if pattern == PATTERN:
        starts, per_text = _cut(data, ends)
        lengths = np.diff(np.append(starts, len(data)))
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    else:
        starts, lengths, per_text = _cut_by(data, ends, pattern)
        pieces = pa.array([data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.binary())
    coded = pieces.dictionary_encode()
    names = coded.dictionary.to_pylist()
    row = np.fromiter((words.rows.get(x, -1) for x in names), np.int64, len(names))
    lacking = np.flatnonzero(row < 0)
    if len(words.rows) + len(lacking) > words.keep:
        words.forget()
        lacking = np.arange(len(names))
    if len(lacking):
        words.add([names[i] for i in lacking], *_merged(coded.dictionary.take(pa.array(lacking)), words))
        row = np.fromiter((words.rows[x] for x in names), np.int64, len(names))
    flat, bounds = np.concatenate(words.ids), np.concatenate(words.ends)
    words.ids, words.ends = [flat], [bounds]
    row = row[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
    each = bounds[row + 1] - bounds[row]
    ids = flat[ragged(bounds[row], each)]
    total = np.concatenate([[0], np.cumsum(each)])
    return ids, np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])


def decode_ids(ids: np.ndarray, counts: np.ndarray, words: Vocabulary) -> list[bytes]:
    """The bytes of lists of ids that stand one behind the other."""
    known = (ids >= 0) & (ids < len(words.lengths))
    safe = np.where(known, ids, 0)
    each = np.where(known, words.lengths[safe] if len(words.lengths) else 0, 0)
    data = words.text[ragged(words.starts[safe], each)].tobytes()
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _parts(text: str) -> list[str]:
    """A text in parts of about PART characters, cut before a space behind an ASCII letter or mark."""
    out, begin = [], 0
    while len(text) - begin > PART:
        at = begin + PART
        while (at := text.find(" ", at)) >= 0 and not "!" <= text[at - 1] <= "~":
            at += 1
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def _encoded(texts: pa.Array, words: Vocabulary, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    if len(texts) == 1 and pattern == PATTERN and len(text := texts[0].as_py()) > PART:
        done = [encode_texts(pa.array([x]), words)[0] for x in _parts(text)]
        return np.concatenate(done), np.array([sum(map(len, done))])
    return encode_texts(texts, words, pattern)


def _by_batch(path: str, pattern: str, columns: Callable[[pa.Array, np.ndarray, np.ndarray, Vocabulary], dict[str, pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in small_batches(batches, 1, PART):
            yield record_batch(columns(batch.column(0), *_encoded(as_strings(batch.column(1)), words, pattern), words))
        words.forget()
        release_memory()

    return run


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def columns(keys: pa.Array, ids: np.ndarray, counts: np.ndarray, words: Vocabulary) -> dict[str, pa.Array]:
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return {"doc_id": keys, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))}

    return rows.mapInArrow(_by_batch(ranks_path, pattern, columns), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text (binary: a list may end within a character) of every list of ids."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull()).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                lists = some.column(1)
                ends = lists.offsets.to_numpy()
                yield record_batch({"doc_id": some.column(0), "text": pa.array(decode_ids(lists.flatten().to_numpy(zero_copy_only=False), np.diff(ends), words), pa.binary())})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256: encoded, then decoded."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def columns(keys: pa.Array, ids: np.ndarray, counts: np.ndarray, words: Vocabulary) -> dict[str, pa.Array]:
        raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]).tolist()
        coded = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        back = [hashlib.sha256(x).hexdigest() for x in decode_ids(ids, counts, words)]
        return {"doc_id": keys, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return rows.mapInArrow(_by_batch(ranks_path, pattern, columns), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
