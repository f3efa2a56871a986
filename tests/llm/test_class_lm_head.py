"""op5's counts and scores are the same whatever words all tasks hold; class bigrams are those of all words' own classes."""

import random
from collections import Counter

import pytest

from basalt.llm import class_lm


def texts(n):
    rng = random.Random(8)
    return [(d, " ".join(f"{rng.choice('abc')}{min(int(rng.paretovariate(0.6)), 10**6)}{rng.choice(['ing', 'ed', 's', ''])}" for _ in range(rng.randrange(60)))) for d in range(n)] + [(n, None), (n + 1, ""), (n + 2, "unseen words here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(600), "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("head", [0, 40, 900])
def test_scores_do_not_depend_on_the_head(spark, monkeypatch, docs, head):
    def scored():
        return {r.doc_id: r for r in class_lm.score(docs, docs.where("doc_id < 590"), sweeps=2).collect()}

    want = scored()
    monkeypatch.setattr(class_lm, "HEAD", head)
    got = scored()
    assert want.keys() == got.keys() and len(want) == 603
    for d, r in want.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert abs(got[d].score - r.score) < 1e-9 * abs(r.score) and abs(got[d].base_score - r.base_score) < 1e-9 * abs(r.base_score)


@pytest.mark.parametrize("held", [0, 30, 10**6])
def test_class_bigrams_equal_plain_counting(spark, docs, held):
    import numpy as np
    import pyarrow as pa

    classes = 7
    rows = [(d, (t or "").lower().split()) for d, t in texts(600)]
    words = sorted({w for _, t in rows for w in t})
    hashed = {w: int(h) for w, h in zip(words, class_lm._tokens(pa.array(words))[0][::2].view(np.int64), strict=True)}
    of = {w: 1 + k % (classes - 1) for k, w in enumerate(words)}
    vocabulary = spark.createDataFrame([(hashed[w], of[w]) for w in words], "word long, class int")
    keys = np.array([hashed[w] for w in words[:held]] + [int(class_lm.END.astype(np.int64))], np.int64).view(np.uint64)
    head = class_lm.Lookup(keys, np.array([5 * classes + of[w] for w in words[:held]] + [9 * classes], np.int64))
    got = class_lm._counted_steps(docs.select("text"), vocabulary, spark.sparkContext.broadcast(head), classes).collect()
    want = Counter()
    for _, t in rows:
        k = [0, *(of[w] for w in t), 0]
        want.update(zip(k[:-1], k[1:], strict=True))
    assert {(r["first"], r["last"]): r.n for r in got} == dict(want)
