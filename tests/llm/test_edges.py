"""Cases at the edge of the operators: nothing to learn from, short items, hot texts, and files read in part."""

import glob
import random
import time

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from basalt.llm import bloom, class_lm, decontaminate, langid, near_dup, queries, secrets, token_table, urlfilter

DOCS = "doc_id long, text string"


def test_op5_better_than_its_base(spark, small):
    held = queries.op5_class_lm(spark, small).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_op5_every_word_has_a_class(spark):
    """Words that stand in the same places get the same class, frequent or not."""
    rng = random.Random(2)
    nouns, verbs = [f"n{k}" for k in range(1200)], [f"v{k}" for k in range(1200)]
    texts = [" ".join(w for _ in range(40) for w in ("the", rng.choice(nouns), "does", rng.choice(verbs))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    probe = spark.createDataFrame([(1, "the n1100 does v1100"), (2, "the v1100 does n1100")], DOCS)
    score = {r.doc_id: r.score for r in class_lm.score(probe, rows).collect()}
    assert score[1] > score[2] + 0.5


def test_op5_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "a a")], DOCS)
    out = {r.doc_id: r for r in class_lm.score(docs, docs.limit(0)).collect()}
    assert [(out[k].n_tokens, out[k].n_known, out[k].train_tokens) for k in (1, 2, None)] == [(3, 0, 0), (1, 0, 0), (3, 0, 0)]
    assert all(r.base_score == 0 and r.score <= 0 for r in out.values())
    assert class_lm.score(docs.limit(0), docs).count() == 0
    assert class_lm.score(docs.limit(0), docs.limit(0)).count() == 0


def held_items(rows, items, low=80, of=100):
    """Pairs by comparing every item at every place, items of any length."""
    words = lambda t: brute.words((t or "").translate(brute.LOWER))
    out = set()
    for i, t in items:
        item = words(t)
        for d, text in rows:
            own = words(text)
            places = range(1 - len(item), len(own)) if item else ()
            if any(of * sum(0 <= s + k < len(own) and own[s + k] == w for k, w in enumerate(item)) >= low * len(item) for s in places):
                out.add((d, i))
    return out


def test_op4_items_of_every_length(spark):
    rng = random.Random(1)
    word = lambda: f"v{rng.randrange(40)}{rng.randrange(3)}"
    items = [(k, " ".join(word() for _ in range(m))) for k, m in enumerate([1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 12, 20, 40] * 2)] + [(500, "x " * 50), (501, None), (502, " ")]
    rows = []
    for d in range(150):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(2):
            planted = rng.choice(items[:26])[1].split()
            for k in rng.sample(range(len(planted)), len(planted) // 5):
                planted[k] = "zz"
            at = rng.randrange(len(text) + 1)
            text[at:at] = planted
        rows.append((d, " ".join(text)))
    rows += [(1000, "X " * 3000), (1001, None), (1002, ""), (1003, rows[0][1]), (None, rows[1][1])]
    got = decontaminate.contaminated(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", seed string, item int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == held_items(rows, items)
    # a text of one word that an item repeats: one row, not one for each place
    assert [(r.item_id, r.first_word, r.end_word) for r in got if r.doc_id == 1000] == [(500, 0, 3000)]


def plain_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(brute.LOWER), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def test_op2_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "https://Sub.Example.ORG/es/x?y"), (5, "https://example.org/en/1"), (6, "a://b://c"), (7, "https://x.com?q"), (None, "https://x.com/fr/"), (8, "https://x.com/de/#f"), (8, "https://x.com/de/#f"), (9, "https://notexample.org/es/")]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted(map(tuple, queries.op2_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    want = []
    for page, url in rows:
        host, path = plain_url(url)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((page, host, path, best[1], best[2]))
    assert out == sorted(want, key=repr)
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


def test_op3_reads_in_part(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("a b c "), (F.col("id") % 50).cast("int"))).alias("text"))
    token_table.write_tokens(docs, f"{tmp_path}/tokens", queries.tokenizer_path(), 2)
    got = token_table.read_documents(spark, f"{tmp_path}/tokens", [7, 2999, -1]).collect()
    assert sorted((r.doc_id, r.n_tokens, len(r.tokens)) for r in got) == [(7, 23, 23), (2999, 149, 149)]
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/tokens/*.parquet"))[0]).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings) and columns["doc_id"].has_offset_index
    assert any("DELTA" in e for e in columns["doc_id"].encodings)


def test_op1_many_findings_in_one_text(spark):
    rng = random.Random(4)
    text = " ".join("%032x" % rng.getrandbits(128) for _ in range(16_000))
    began = time.time()
    r = secrets.scan(spark.createDataFrame([(1, text)], DOCS)).select("n_hex", F.element_at("findings", -1).alias("x")).first()
    assert (r.n_hex, r.x.s, r.x.e) == (16_000, len(text) - 32, len(text)) and time.time() - began < 60


def test_op8_template_without_links(spark):
    base = [f"b{k * 7919 % 100_003}" for k in range(220)]
    rows = [(d, " ".join([*base[:100], *(f"o{d}x{k}" for k in range(20)), *base[100:]])) for d in range(6000)]
    began = time.time()
    assert near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).where("kept").count() == 6000
    assert time.time() - began < 120


@pytest.mark.parametrize("parts", [1, 150])
def test_bloom_holds_all_its_keys(spark, parts):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k")).repartition(parts)
    f = bloom.build(keys, 20_000)
    own = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert f.may_hold(own).all() and f.may_hold(own ^ np.uint64(12345)).mean() < 0.02
    assert not bloom.build(keys.limit(0), 0).may_hold(own).any()


def test_op9_counts_all_documents(spark):
    rows = [(k, f"das ist ein satz nummer {k}", "de") for k in range(40)] + [(k, f"this is sentence number {k}", "en") for k in range(40, 80)] + [(90, None, "en"), (91, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "ist das ein satz"), (2, "is this a sentence"), (3, "123"), (4, None)], DOCS), model).collect()}
    assert out == {1: "de", 2: "en", 3: "und", 4: "und"}
