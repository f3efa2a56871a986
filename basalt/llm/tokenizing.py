"""Encoding of whole texts with a tokenizers file, chunk by chunk with a cache.

The tokenizer lower-cases, treats white space alone as a boundary and never lets a token reach over a change
between letters and punctuation. So the ids of a text are the ids of its white-space-separated chunks, and
those of a plain word with punctuation behind it are the ids of the word and of the punctuation. Each
distinct unit is encoded once by the library: words of small Latin letters, which neither normalizer nor
splitter would change, by its model and byte alphabet alone, everything else by all its steps. Texts that
may name a special token are encoded whole. Short chunks that came before are looked up by their bytes in a
table of fixed size, all at once; only the others are cut into units. Tests hold all this against the plain call.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from basalt.llm.common import ragged, split_words
from basalt.llm.shingles import mix

_ENCODERS: dict[str, UnitEncoder] = {}

#: Small letters that normalization leaves as they are.
PLAIN = "[a-zß-öø-ÿ]+"
#: A plain word and punctuation that is no apostrophe and opens no special token.
WITH_TAIL = f'^(?P<core>{PLAIN})(?P<tail>[-.,;:!?*&#$%"()/=+_]+)$'


#: Slots of the table of short chunks, a power of two; bytes of a short chunk at most.
SLOTS, SHORT = 1 << 18, 15


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def short_keys(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings and their number in two integers; strings of no byte or more than SHORT have 0 and 0."""
    offsets, data = strings.buffers()[1:]
    ends = np.frombuffer(offsets, "<i4")[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    base, size = ends[0], ends[-1] - ends[0]
    held = np.zeros(size + 16, np.uint8)
    if size:
        held[:size] = np.frombuffer(data, np.uint8)[base : base + size]
    eight = np.ndarray((size + 9,), "<u8", held, strides=(1,))  # the eight bytes from every place on
    starts, n = ends[:-1] - base, np.diff(ends)
    low, high = np.clip(n, 0, 8), np.clip(n - 8, 0, 7)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    first, second = eight[starts] & masks[low], eight[np.minimum(starts + 8, size)] & masks[high] | n.astype(np.uint64) << np.uint64(56)
    other = (n == 0) | (n > SHORT)
    first[other] = second[other] = 0
    return first, second


class UnitEncoder:
    """ids of texts; remembers the ids of distinct units between batches, and once they are over `keep` those of the half that is used most."""

    def __init__(self, path: str, keep: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain, self.keep = Tokenizer.from_file(path), Tokenizer.from_file(path), keep
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.tokenizer.model.end_of_word_suffix or "\0"
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for name, i in self.tokenizer.get_vocab().items() if name.endswith(mark)]] = True
        self.rows: dict[str, int] = {"": 0}
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(2, np.int64)]
        self.hits, self.keys, self.units = np.zeros(1, np.int32), np.zeros((2, SLOTS), np.uint64), np.zeros((SLOTS, 2), np.int32)

    def _trim(self) -> None:
        """Keep the units that most batches asked for again, half of `keep` of them at most."""
        hits, ends = self.hits, np.concatenate(self.ends)
        hits[0] = np.iinfo(np.int32).max  # the empty unit
        best = np.argsort(-hits, kind="stable")[: max(1, self.keep // 2)]
        stay = np.sort(best[hits[best] > 0])
        lengths, names = ends[stay + 1] - ends[stay], list(self.rows)
        self.rows = {names[row]: k for k, row in enumerate(stay.tolist())}
        self.ids = [np.concatenate(self.ids)[ragged(ends[stay], lengths)]]
        self.ends = [np.concatenate([[0], np.cumsum(lengths)])]
        number = np.full(len(hits), -1, np.int32)
        number[stay] = np.arange(len(stay))
        self.hits, self.units = hits[stay] // 2, number[self.units]
        self.keys[:, (self.units < 0).any(1)] = 0

    def _add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.rows.update(zip(names, range(len(self.rows), len(self.rows) + len(names)), strict=True))
        self.ids.append(ids.astype(np.int32))
        self.ends.append(self.ends[-1][-1] + np.cumsum(lengths))

    def _learn(self, words: list[str], others: list[str]) -> None:
        for a in range(0, len(words), 200):  # short runs stay in the processor's cache
            part = words[a : a + 200]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):  # every word ends with a token that carries the end-of-word mark
                self._add(part, ids, np.diff(ends, prepend=0))
            else:
                others = others + part
        for a in range(0, len(others), 5000):
            part = others[a : a + 5000]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            self._add(part, np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum())), lengths)

    def _known(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.get, names, repeat(-1)), np.int64, len(names))

    def _units(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._known(words), self._known(others)]
        lacking = [np.flatnonzero(rows < 0) for rows in found]
        names = [[x[i] for i in at] for x, at in zip((words, others), lacking, strict=True)]
        self._learn(*(list(dict.fromkeys(x)) for x in names))
        for rows, at, x in zip(found, lacking, names, strict=True):
            rows[at] = self._known(x)
        return tuple(found)

    def _cut(self, names: pa.Array) -> np.ndarray:
        """The two units of each chunk, by its letters; the empty one stands for none."""
        is_word = pc.match_substring_regex(names, f"^{PLAIN}$").to_numpy(zero_copy_only=False)
        parts = pc.extract_regex(names.filter(pa.array(~is_word)), WITH_TAIL)
        has_tail = parts.is_valid().to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~is_word)
        tailed, whole = rest[has_tail], rest[~has_tail]
        parts = parts.filter(pa.array(has_tail))
        words = _listed(names.filter(pa.array(is_word))) + _listed(parts.field("core"))
        others = _listed(names.take(pa.array(whole))) + _listed(parts.field("tail"))
        word_rows, other_rows = self._units(words, others)
        units = np.zeros((len(names), 2), np.int32)
        units[np.flatnonzero(is_word), 0] = word_rows[: int(is_word.sum())]
        units[tailed, 0], units[tailed, 1] = word_rows[int(is_word.sum()) :], other_rows[len(whole) :]
        units[whole, 0] = other_rows[: len(whole)]
        return units

    def _looked_up(self, names: pa.Array) -> np.ndarray:
        """The two units of each chunk: of short ones that have a slot from there, of the others by their letters."""
        if len(self.rows) > self.keep:
            self._trim()
        first, second = short_keys(names)
        slot = (mix(first ^ mix(second, 51), 52) & np.uint64(SLOTS - 1)).astype(np.int64)
        units, new = self.units[slot], np.flatnonzero((self.keys[0][slot] != first) | (self.keys[1][slot] != second) | (second == 0))
        units[new] = self._cut(names.take(pa.array(new)))
        if len(self.hits) < len(self.rows):
            self.hits = np.concatenate([self.hits, np.full(len(self.rows) - len(self.hits), -1, np.int32)])
        self.hits[units[:, 0]] += 1
        self.hits[units[:, 1]] += 1
        new = new[second[new] > 0]
        new = new[np.unique(slot[new], return_index=True)[1]]  # one chunk a slot
        self.keys[0, slot[new]], self.keys[1, slot[new]], self.units[slot[new]] = first[new], second[new], units[new]
        return units

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) of the texts, and the number of ids of each text."""
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        lowered = pc.ascii_lower(texts)
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            lowered = pc.if_else(pa.array(mask), "", lowered)
        chunks, per_text = split_words(lowered)
        coded = chunks.dictionary_encode()
        names = coded.dictionary
        units = self._looked_up(names)
        flat, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        self.ids, self.ends = [flat], [ends]
        first, each = ends[units], ends[units + 1] - ends[units]
        of_chunks = flat[ragged(first.ravel(), each.ravel())]
        lengths = each.sum(1)
        starts = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = lengths[index]
        out = of_chunks[ragged(starts[index], lengths)]
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per_text)])])
        if len(odd):
            cuts = np.split(out, np.cumsum(counts)[:-1])
            for i in odd:
                cuts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
            out, counts = np.concatenate(cuts), np.fromiter(map(len, cuts), np.int64, len(cuts))
        return out, counts


def encoder(path: str) -> UnitEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
