"""op5's second step on a word with very many occurrences: merged before it is weighed, with the same class as from plain sums."""

import tracemalloc

import numpy as np
import pyarrow as pa

from basalt.llm import class_lm


class Shared:
    def __init__(self, value):
        self.value = value


def test_a_frequent_word_is_merged_first():
    rng, classes = np.random.default_rng(5), 64
    before, after = (np.asfortranarray(rng.normal(size=(classes, classes))).copy() for _ in range(2))
    parts = []
    for k in range(150):
        code = rng.choice(classes * classes, 4000, replace=False).astype("<u2")
        word = np.where(np.arange(4000) < 3900, 7, rng.integers(100, 140, 4000)).astype("<u8")
        order = np.lexsort((code, word))
        parts.append((word[order], code[order], rng.integers(1, 9, 4000).astype("<i4")))
    batches = [pa.RecordBatch.from_pydict({"bucket": [0], "word": [w.tobytes()], "code": [c.tobytes()], "n": [n.tobytes()]}) for w, c, n in parts]
    model = Shared((class_lm.Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(1 + class_lm.ENDINGS, np.int64), before, after))
    tracemalloc.start()
    got = {}
    for b in class_lm._moved(model, classes)(iter(batches)):
        got |= {w: (n, c) for w, n, c in zip(*(b.column(k).to_pylist() for k in ("word", "n", "class")), strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sums = {}
    for words, code, n in parts:
        for w in np.unique(words):
            at = words == w
            gain = ((before[code[at] // classes] + after[code[at] % classes]) * n[at, None]).sum(0)
            total, old = sums.get(int(w), (0, 0))
            sums[int(w)] = (total + int(n[at].sum()), old + gain)
    assert got == {w: (n, int(np.argmax(g))) for w, (n, g) in sums.items()}
    assert peak < 100e6, peak  # 585,000 rows of 64 classes were 300 MB before
