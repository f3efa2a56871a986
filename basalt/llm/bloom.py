"""A blocked Bloom filter of 64-bit keys: every key sets a few bits of one 512-bit block, one cache line.

The number of blocks is fixed by a size limit, never by the data, so a filter can be sent to all tasks. A
filter that is too full for its keys lets more through; what follows it must be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basalt.llm.common import record_batch
from basalt.llm.shingles import mix

PROBES = 6
BLOCK_BITS = 512


class BlockedBloom:
    def __init__(self, blocks: int, words: np.ndarray | None = None):
        self.blocks = blocks
        self.words = np.zeros(blocks * 8, np.uint64) if words is None else words

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 16, most_bytes: int = 8 << 20) -> BlockedBloom:
        """For about so many keys; most_bytes bounds it whatever their number."""
        wanted = max(1, min(keys * bits_per_key // BLOCK_BITS + 1, most_bytes * 8 // BLOCK_BITS))
        return cls(1 << (wanted - 1).bit_length())

    def _places(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = mix(keys, 31)
        block, bits = (h >> np.uint64(34)) % np.uint64(self.blocks), mix(h, 32)
        for k in range(PROBES):
            bit = (bits >> np.uint64(9 * k)) & np.uint64(511)
            yield (block * np.uint64(8) + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, keys: np.ndarray) -> None:
        for at, bit in self._places(keys):
            np.bitwise_or.at(self.words, at, bit)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found, left = np.zeros(len(keys), bool), np.arange(len(keys))
        h = mix(keys, 31)
        bits = mix(h, 32)
        first = ((h >> np.uint64(34)) % np.uint64(self.blocks) * np.uint64(8)).astype(np.int64)
        for k in range(PROBES):  # most keys end at the first probe
            bit = (bits >> np.uint64(9 * k)) & np.uint64(511)
            hit = (self.words[first + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
            left, first, bits = left[hit], first[hit], bits[hit]
        found[left] = True
        return found


#: Partial filters that are merged at most, and pieces that each is cut into for that.
PARTIAL, SLICES = 64, 16


def build(keys: DataFrame, size: int, most_bytes: int = 8 << 20) -> BlockedBloom:
    """A filter of the one long column of keys. Tasks make filters of the same fixed size and merge them piece by piece; the driver gets one."""
    blocks = BlockedBloom.sized(size, most_bytes=most_bytes).blocks
    cut = min(SLICES, blocks)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = BlockedBloom(blocks), False
        for batch in batches:
            if batch.num_rows:
                own.add(np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)))
                seen = True
        if seen:
            yield record_batch({"slice": pa.array(range(cut), pa.int32()), "words": pa.array([x.tobytes() for x in np.split(own.words, cut)], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        words = np.frombuffer(table.column("words")[0].as_py(), np.uint64).copy()
        for x in table.column("words")[1:]:
            words |= np.frombuffer(x.as_py(), np.uint64)
        return pa.table({"slice": table.column("slice")[:1], "words": pa.array([words.tobytes()], pa.binary())})

    whole = BlockedBloom(blocks)
    width = len(whole.words) // cut
    few = keys.coalesce(PARTIAL).mapInArrow(part, "slice int, words binary").groupBy("slice").applyInArrow(merged, "slice int, words binary")
    for row in few.collect():  # SLICES rows, most_bytes in all
        whole.words[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row.words, np.uint64)
    return whole
