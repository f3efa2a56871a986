"""Redaction of many findings, and what the quality rules learn from."""

import random

from pyspark.sql import functions as F

from basalt.llm import quality, secrets


def plain(text, spans):
    hidden = sorted(spans)
    out, at = "", 0
    for s, e in hidden:
        if s >= at:
            out += text[at:s] + "[redacted]"
        at = max(at, e)
    return out + text[at:]


def test_redact_equals_plain(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab é中\U0001f600\n") for _ in range(rng.choice([0, 5, 400, 3000])))
        spans = []
        for _ in range(rng.choice([0, 1, 5, secrets.BLOCK, secrets.BLOCK + 1, 3 * secrets.BLOCK + 7]) if text else 0):
            s = rng.randrange(len(text))
            spans.append((s, rng.randrange(4), min(len(text), s + rng.choice([1, 2, 9, 200]))))
        rows.append((k, text, sorted(spans)))
    docs = spark.createDataFrame(rows, "doc_id int, text string, findings array<struct<s: int, kind: int, e: int>>")
    got = {r.doc_id: r.clean for r in docs.select("doc_id", secrets.redact().alias("clean")).collect()}
    assert got == {k: plain(t, [(s, e) for s, _, e in f]) for k, t, f in rows}


def test_many_findings_in_one_text(spark):
    words = [f"{k:032x}" for k in range(6000)]
    r = secrets.scan(spark.createDataFrame([(1, " x ".join(words))], "doc_id long, text string")).select(secrets.redact().alias("clean")).first()
    assert r.clean == " x ".join(["[redacted]"] * 6000)


def labelled(spark, n=600):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["word", "other", "thing", "more"]) + str(rng.randrange(900)) * (k % 2) + "#!" * (k % 2) for _ in range(rng.randrange(30, 60)))) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(12), [(k, 1 - k % 2) for k in range(n)]


def test_labels_of_both_kinds(spark):
    docs, labels = labelled(spark)
    both = labels + [(k, q) for k in range(8) for q in (0, 1)]  # few enough for rules of the precision asked for
    frames = [spark.createDataFrame(rows, "doc_id long, quality int").repartition(parts) for rows, parts in ((both, 1), (both[::-1], 3))]
    first, second = (quality.learn(docs, f) for f in frames)
    assert first and first == second
    out = quality.judged(docs, frames[0]).select("doc_id", "kept", "base_failed").collect()
    assert sum(r.kept == (r.doc_id % 2 == 0) for r in out if not r.base_failed) >= 0.95 * len(out)


def test_documents_are_read_in_all_their_tasks(spark, monkeypatch):
    docs, labels = labelled(spark, 60)
    parts, real = {}, quality.written

    def noted(df, name, **options):
        parts[name] = df.rdd.getNumPartitions() if name == "labelled" else None
        return real(df, name, **options)

    monkeypatch.setattr(quality, "written", noted)
    quality.learn(docs, spark.createDataFrame(labels[:60], "doc_id long, quality int"))
    assert parts["labelled"] == docs.rdd.getNumPartitions() == 12
    assert docs.select(F.count(F.lit(1))).first()[0] == 60
