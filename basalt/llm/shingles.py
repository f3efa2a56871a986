"""Word shingles of whole texts as 64-bit hashes, for batches of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                row = np.full(max(n, _PIECE), base, np.uint64)
                row[0] = 1
                _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(256, dtype=np.uint64), 5)
    values[65:91] = values[97:123]
    gaps = np.zeros(256, bool)
    gaps[[32, *range(9, 14)]] = True
    return values, gaps


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text starts and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased) of the texts, and the number of words of each."""
    hashes, counts, _ = words_and_endings(texts)
    return hashes, counts


def words_and_endings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(), and of every word its last two bytes as a number (A-Z lower-cased; the first of them 0 in a word of one)."""
    data, offsets = text_bytes(texts)
    hashes, counts, endings, a = [], [], [], 0
    small = np.arange(256, dtype=np.int32)
    small[65:91] += 32
    values, gaps = _tables()
    with np.errstate(over="ignore"):
        while a < len(texts):  # some hundred kB at a time stay in the processor's cache
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _PIECE // 4)) - 1)
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            n = len(part)
            gap = gaps[part]
            begins, ends = ~gap, ~gap
            begins[1:] &= gap[:-1]
            ends[:-1] &= gap[1:]
            inner = cuts[(cuts > 0) & (cuts < n)]  # words end with their text
            begins[inner] |= ~gap[inner]
            ends[inner - 1] |= ~gap[inner - 1]
            first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            up, down = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values[part] * up[:n], out=total[1:])
            hashes.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
            counts.append(np.diff(np.searchsorted(first, cuts)))
            endings.append(small[part[last - 1]] + 256 * np.where(last - first > 1, small[part[last - 2]], 0))
            a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(counts).astype(np.int64), np.concatenate(endings)


#: Odd multipliers of the words' places in a shingle.
PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other, and the number of each text.

    A text of fewer words than width has its whole word sequence as one shingle; a text without words none.
    """
    words, counts = word_hashes(texts)
    ends, out = np.cumsum(counts), []
    with np.errstate(over="ignore"):
        for a, b in zip(ends - counts, ends, strict=True):
            n = int(b - a)
            if not n:
                out.append(words[:0])
                continue
            few = min(n, width)
            h = words[a : b - few + 1] * PLACES[0]
            for k in range(1, few):
                h = h + words[a + k : b - few + 1 + k] * PLACES[k]
            h = np.sort(mix(h, few - width))
            out.append(h[np.append(True, h[1:] != h[:-1])])
    return (np.concatenate(out) if out else words[:0]), np.fromiter(map(len, out), np.int64, len(out))


def multipliers(coordinates: int) -> np.ndarray:
    """Odd factors, one for each coordinate of a signature."""
    return mix(np.arange(1, coordinates + 1, dtype=np.uint64), 7) | np.uint64(1)


def coordinate_minima(sets: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures (uint32), a row for each set of at least one shingle, in order."""
    counts = counts[counts > 0]
    ends = np.cumsum(counts)
    out = np.empty((len(counts), coordinates), np.uint32)
    factors, a = multipliers(coordinates), 0
    while a < len(counts):  # a few tens of thousands of shingles at a time stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + 30_000)))
        low = ends[a] - counts[a]
        part, starts = sets[low : ends[b - 1]], ends[a:b] - counts[a:b] - low
        buffer = np.empty_like(part)
        for k in range(coordinates):
            np.multiply(part, factors[k], out=buffer)
            out[a:b, k] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
        a = b
    return out


def set_keys(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set; equal sets have equal ones."""
    ends = np.cumsum(counts)
    out = []
    for seed in (101, 102):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets, seed), dtype=np.uint64)])
            out.append(total[ends] - total[ends - counts])
    return np.stack(out, 1).view(np.int64)
