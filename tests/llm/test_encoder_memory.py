"""What the encoder remembers, and the checksums of pieces that are taken with the encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import packing, queries, tokenizing

PATH = queries.tokenizer_path()
LETTERS = "abcdefghijklmnopqrstuvwxyzéñ"


def plain(text):
    return tokenizing.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def checked(code, texts):
    ids, counts = code.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


def word(rng):
    return "".join(rng.choices(LETTERS, k=rng.randrange(5, 12)))


def test_used_words_are_learned_once():
    """Words that come in every batch stay when the memory is full of words that came once."""
    code, rng, learned = tokenizing.UnitEncoder(PATH, keep=1000), random.Random(1), []
    learn = code._learn
    code._learn = lambda words, others: (learned.extend(words), learn(words, others))
    common = [word(rng) for _ in range(100)]
    for _ in range(12):
        checked(code, [" ".join([*common, *(word(rng) for _ in range(300))])])
    assert len(code.rows) < 1500
    assert all(learned.count(w) == 1 for w in common)


@pytest.mark.parametrize("slots", [1, 8, 1 << 18])
def test_short_and_long_chunks_share_slots(monkeypatch, slots):
    monkeypatch.setattr(tokenizing, "SLOTS", slots, raising=False)
    code, rng = tokenizing.UnitEncoder(PATH, keep=200), random.Random(2)
    odd = ["a", "a\0", "a\0\0", "\0", "12345678", "123456781", "abcdefghijklmno", "abcdefghijklmnop", "éééééééé", "éééééééa", "the,", "The,", "don't", "x" * 300, "日本語", "ét", "<|endoftext|>"]
    for _ in range(6):
        texts = [" ".join(rng.choices(odd, k=9)) for _ in range(20)] + [" ".join(word(rng) for _ in range(50)), "", None, " "]
        checked(code, [t or "" for t in texts])


def test_short_keys_are_exact():
    names = pa.array(["", "a", "a\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "b" * 15, "b" * 16, "é"])
    keys = list(zip(*(x.tolist() for x in tokenizing.short_keys(names)), strict=True))
    assert keys[0] == keys[7] == (0, 0) and len(set(keys)) == 8
    assert keys[3:] == list(zip(*(x.tolist() for x in tokenizing.short_keys(names.slice(3))), strict=True))


@pytest.mark.parametrize("kind", ["<u2", "<i4"])
def test_checksums_of_whole_and_cut_pieces(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "id_type", lambda tokenizer: kind, raising=False)
    rng = random.Random(3)
    texts = [" ".join(word(rng) for _ in range(n)) for n in (0, 1, 40, 90, 200, 700, 1500, *(rng.randrange(1, 120) for _ in range(60)))]
    texts += ["the " * n for n in (63, 64, 127, 128)] + [None]  # units of no ids and of one among them
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = sorted(packing.pack_documents(docs, PATH, window=64).collect(), key=lambda p: (p.doc_id, p.start))
    ids, at = {d: np.array([*plain(t), 1], "<u4") for d, t in enumerate(texts)}, dict.fromkeys(range(len(texts)), 0)
    for p in pieces:
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert at == {d: len(x) for d, x in ids.items()}
    assert any(p.length < 64 and p.start % 64 for p in pieces)  # some units are cut
