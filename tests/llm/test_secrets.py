"""Random strings that are joined to other text, have no digit, or hold a pattern match."""

import random
import string

from basalt.llm import secrets

JOINED = ("client_session_request_key={}", "com/services/incoming/webhooks/account/{}", "order-list-item-{}", "{}", "id_{}_number_of_rows_in_table")


def test_joined_secrets_and_plain_runs(spark):
    rng = random.Random(11)
    letters, mixed = string.ascii_letters, string.ascii_letters + string.digits
    rows = []
    for k in range(600):
        key = "".join(rng.choice(letters if k % 2 else mixed) for _ in range(rng.randrange(20, 25)))
        rows.append((k, key, "see " + JOINED[k % len(JOINED)].format(key) + " here"))
    for k in range(600, 1200):
        w = [rng.choice(secrets.NOUNS) for _ in range(7)]
        rows.append((k, None, " ".join(("_".join(w), "".join(map(str.capitalize, w[:4])), "/".join(w[2:]) + str(k), "-".join(w[:5])))))
    docs = spark.createDataFrame(rows, "id long, key string, text string")
    out = secrets.scan(docs).withColumn("clean", secrets.redact()).collect()
    planted, plain = [r for r in out if r.key], [r for r in out if not r.key]
    found, wrong = sum(r.key not in r.clean for r in planted), sum(r.n_markov > 0 for r in plain)
    whole = sum(not any(r.key[i : i + 6] in r.clean for i in range(len(r.key) - 5)) for r in planted)
    print("found", found, "whole", whole, "of", len(planted), "wrong", wrong, "of", len(plain))
    assert whole >= 0.9 * len(planted)
    assert wrong <= 0.05 * len(plain)


def test_rest_of_a_secret_around_a_match(spark):
    text = "id Qz7xK2mBvL4w0123456789abcdef01234567P0rT6uYJ1eC5hWq8 end"
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("clean", secrets.redact()).first()
    assert r.n_hex == 1 and r.n_markov == 1 and r.clean == "id [redacted] end"
