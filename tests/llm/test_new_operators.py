"""Centroid clustering, repair of conversations and byte-level BPE against plain versions."""

import base64
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import ball_tree, byte_bpe, dialogue, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


# --- op11


def plain_clusters(rows, k, rounds, width, scale, seed):
    kept = [(i, [min(max(math.floor(scale * float(x)), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (sha(f"{seed}{'' if r[0] is None else r[0]}".encode()), r[1]))
    centroids = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {}
    for _, j, d in found:
        total[j] = total.get(j, 0) + d
    return sorted((str(i), j, d, total[j], sum(total.values()), sha(",".join(map(str, centroids[j])).encode())) for i, j, d in found)


def listed_clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_op11_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert listed_clusters(queries.op11_ball_tree(spark, small)) == plain_clusters(rows, 40, 5, 64, 256, "2:")


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


def test_op11_edges(spark):
    rng = random.Random(5)
    near = [(k, [rng.choice([0.0, 3.0, 9.0]) + rng.random() / 50 for _ in range(4)]) for k in range(300)]
    odd = [(400, None), (401, [1.0, 2.0, 3.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan"), 0.0, 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (None, [0.0, 1.0, 1.0, 1.0]), (405, [1e30, -1e30, 0.0, 0.0]), (406, [])]
    rows = near + odd + near[:40] + [(500 + k, [2.0, 2.0, 2.0, 2.0]) for k in range(400)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    for k in (1, 7, 40):
        assert listed_clusters(ball_tree.cluster(df, k, 5, width=4)) == plain_clusters(rows, k, 5, 4, 256, "2:")
    few = spark.createDataFrame([(*r, "x", "y") for r in near[:3]], VECTORS)
    assert listed_clusters(ball_tree.cluster(few, 40, 5, width=4)) == plain_clusters(near[:3], 40, 5, 4, 256, "2:")
    assert ball_tree.cluster(df.limit(0), 40, 5, width=4).count() == 0
    assert ball_tree.cluster(df.where("vec_id IN (400, 401)"), 40, 5, width=4).count() == 0


def test_op11_ties_and_whole_balls():
    points = np.array([[x, y] for x in range(40) for y in range(40)], np.int64)
    centroids = np.array([[10, 10], [10, 30], [30, 10], [30, 30], [10, 10]], np.int64)
    tree = ball_tree.Balls.build(points)
    counts, sums, cluster, distance = tree.assign(centroids, wanted=True)
    d = ((points[:, None] - centroids) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert counts.tolist() == np.bincount(d.argmin(1), minlength=5).tolist() and counts[4] == 0
    assert all((sums[j] == points[d.argmin(1) == j].sum(0)).all() for j in range(5))
    _, _, apart, _ = tree.assign(centroids[:4], wanted=True)
    assert (apart == d[:, :4].argmin(1)).all() and 0 < tree.opened < len(points) / 2  # most were assigned by the ball


# --- op12


def plain_edits(letters):
    """The cheapest edits by search over all of them."""
    order = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last):
        found = [(0, "")] if i == len(letters) and last in ("", "a") else []
        own = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if i < len(letters):
            letter, more = letters[i].lower(), 3 * letters[i].isupper()
            found.append(plus(4, "D", best(i + 1, last)))
            if letter != "x":
                if letter in order[last]:
                    found.append(plus(more, "K", best(i + 1, letter)))
                found.append(plus(3 + more, "R", best(i + 1, own)))
        return min([*found, *inserted(i, last, own)])

    def inserted(i, last, own):
        # at most two inserted messages in a row can be of use
        out = []
        for many in (1, 2):
            state, ok = last, True
            for _ in range(many):
                state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            if i == len(letters):
                out += [(3 * many, "I" * many)] if state in ("", "a") and ok else []
            else:
                out.append(plus(3 * many, "I" * many, no_insert(i, state)))
        return out

    @functools.cache
    def no_insert(i, last):
        own = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        letter, more = letters[i].lower(), 3 * letters[i].isupper()
        found = [plus(4, "D", best(i + 1, last))]
        if letter != "x":
            if letter in order[last]:
                found.append(plus(more, "K", best(i + 1, letter)))
            found.append(plus(3 + more, "R", best(i + 1, own)))
        return min(found)

    plus = lambda c, e, x: (c + x[0], e + x[1])
    return best(0, "")


def every_edit(letters):
    """The same by listing every string of edits up to the length that can be of use."""
    found = []

    def go(i, shape, cost, edits, row):
        if cost > 4 * len(letters):
            return
        if i == len(letters) and re.fullmatch("(s?(ua)+)?", shape):
            found.append((cost, edits))
        if row < 2:
            for c in "ua":
                go(i, shape + c, cost + 3, edits + "I", row + 1)
        if i < len(letters):
            letter, more = letters[i].lower(), 3 * letters[i].isupper()
            go(i + 1, shape, cost + 4, edits + "D", 0)
            if letter != "x":
                go(i + 1, shape + letter, cost + more, edits + "K", 0)
                for c in "ua":
                    go(i + 1, shape + c, cost + 3 + more, edits + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_op12_trie_gives_the_cheapest_edits():
    rng = random.Random(4)
    some = sorted({"".join(rng.choice("uasoUASOx") for _ in range(rng.randrange(5))) for _ in range(300)})
    trie = dialogue.Trie()
    for letters in some:
        row = trie.insert("^" + letters)[0]
        assert min(x for x in (row[q] for q in dialogue.ENDS) if x) == plain_edits(letters) == every_edit(letters), letters
    assert trie.made < sum(map(len, some))  # shared prefixes are computed once
    long = sorted("".join(rng.choice("uuaasoUAx") for _ in range(rng.randrange(30))) for _ in range(400))
    for letters in long:
        row = trie.insert("^" + letters)[0]
        assert min(x for x in (row[q] for q in dialogue.ENDS) if x) == plain_edits(letters)


SPACES = " \t\n\x0b\x0c\r"


def plain_dialogue(rows, damage=True):
    by, out = {}, []
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        s = lambda x: " " if x is None else str(x)
        role, text = s(role), s(text)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20 if damage else 9
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, letters, counts = set(), "", dict.fromkeys(dialogue.COUNTS, 0)
        for _, role, text in own:
            initial = role[:1] if role[:1] in ("u", "a", "s") else "o"
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain_edits(letters)
        lines, k = [], 0
        stay = len(audit) - audit.count("D")
        for e in audit:
            made = ("user", "assistant")[(len(lines) - stay % 2) % 2]
            if e in "KR":
                lines.append(f"{own[k][1] if e == 'K' else made}:{own[k][2]}")
            elif e == "I":
                lines.append(made + ":")
            k += e != "I"
        out.append((str(conv), gaps, *counts.values(), cost, audit, sha("\n".join(lines).encode())))
    return sorted(out)


def listed_dialogue(df):
    return sorted((str(r.conv_id), r.gaps, *(r[c] for c in dialogue.COUNTS), r.cost, r.audit, r.repaired_sha256) for r in df.collect())


def test_op12_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed_dialogue(queries.op12_dialogue(spark, small)) == plain_dialogue(rows)


def test_op12_edges(spark):
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a", "été"]
    texts = ["Hi.", "Why? ", "no end", " \n", "", None, "x" * 5000 + "!", "Hi."]
    rows = [(rng.choice([*range(40), None]), rng.choice([*range(9), None, -4]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    rows += [(1000, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(90)] + [(1001, None, "user", "same.")] * 50
    gone = [(c, 0, "user", "x.") for c in range(2000, 2200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    kind = "conv_id long, turn long, role string, text string, cost string, segment string"
    df = spark.createDataFrame([(*r, "q", "q") for r in rows + gone], kind).repartition(5)
    want = plain_dialogue(rows + gone)
    assert any(w[6:] == ("", sha(b"")) or w[7] == "" for w in want)
    for cut in (512, 7, 1):  # conversations in one segment or many
        got = listed_dialogue(dialogue.report(dialogue.repair(dialogue.damaged(df), F.col("present"), cut)))
        assert got == want, cut
    assert listed_dialogue(dialogue.report(dialogue.repair(df))) == plain_dialogue(rows + gone, damage=False)
    assert dialogue.report(dialogue.repair(dialogue.damaged(df.limit(0)), F.col("present"))).count() == 0


def test_op12_one_signature_for_a_third_of_all(spark):
    """Conversations of one signature may be split over tasks; all get the same answer."""
    rows = [(c, t, ("user", "user", "assistant")[t], f"{c} {t}.") for c in range(700) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = dialogue.answers(dialogue.segments(df)).select(F.spark_partition_id().alias("p"), F.to_json("best").alias("b"))
    assert got.select("b").distinct().count() == 1 and got.count() == 700


# --- op13


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_ids(encoding, text):
    return encoding.encode_ordinary(text or "")


def differing(encoding, texts):
    ids, counts = byte_bpe.encode_texts(pa.array(texts, pa.string()), byte_bpe.vocabulary(RANKS))
    ends = np.cumsum(counts)
    return [x for x, a, b in zip(texts, ends - counts, ends, strict=True) if ids[a:b].tolist() != plain_ids(encoding, x)]


def test_op13_fixed_pattern():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_op13_whole_table(spark, small, encoding):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_byte_bpe(spark, small).collect())
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = plain_ids(encoding, r.text)
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert got == sorted(want)


def test_op13_cuts_as_the_pattern(encoding):
    rng = random.Random(3)
    letters = list(" '  \n\t\r\x85\xa0　.,!sStTrReEvVmMlLdD019é—漢٣🙂")
    assert differing(encoding, ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(20_000)]) == []
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert differing(encoding, [f"a{c}b 1{c}2 {c} " for c in points]) == []


def test_op13_merges_of_short_and_long_pieces(encoding):
    rng = random.Random(7)
    for many in (1, 5, 400):
        assert differing(encoding, ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 60))) for _ in range(many)]) == []
    assert differing(encoding, ["ab" * 3000, "a" * 5001, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "=" * 999, "\n" * 70]) == []


def test_op13_cuts_long_texts_at_borders(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 100)
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["  ", " ", "word", "don't", "\n ", "é ", "漢", "12"]) for _ in range(300))
        assert "".join(byte_bpe._parts(text)) == text
        ids, counts = byte_bpe._encoded(pa.array([text]), byte_bpe.vocabulary(RANKS), byte_bpe.PATTERN)
        assert ids.tolist() == plain_ids(encoding, text) and counts.tolist() == [len(ids)]


def test_op13_edges(spark, encoding):
    texts = [None, "", " ", "don't we'll", "a" * 3000, "word " * 4000, "漢字 " * 300, "no space".replace(" ", "") * 900, "<|endoftext|>", "x\x00y", "tab\t\tend  "]
    rows = [(k % 7 if k else None, t, [1], "c") for k, t in enumerate(texts + texts[3:6])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens string")
    shape = lambda rs: sorted(map(str, rs))
    coded = byte_bpe.encode(df, RANKS)
    assert shape((r.doc_id, r.ids) for r in coded.collect()) == shape((i, plain_ids(encoding, t)) for i, t, *_ in rows)
    assert shape((r.doc_id, bytes(r.text)) for r in byte_bpe.decode(coded, RANKS).collect()) == shape((i, (t or "").encode()) for i, t, *_ in rows)
    odd = spark.createDataFrame([(1, None), (2, [None, 5]), (3, [-1, 99_999_999]), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.text) for r in byte_bpe.decode(odd, RANKS).collect()} == {1: b"", 2: encoding.decode_bytes([5]), 3: b"", 4: b""}
    assert byte_bpe.round_trip(df.limit(0), RANKS).count() == 0
    numbers = byte_bpe.encode(df.limit(3), RANKS, pattern=r"\p{L}+").collect()
    assert shape(r.ids for r in numbers) == shape([[], [], []])
