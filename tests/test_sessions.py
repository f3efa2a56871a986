"""Verdicts of sessions against a plain pass over their findings."""

import random
import re

from basalt.operators import sessions

SPEC = [("s1", "GET /v1/users/{id}"), ("s1", "POST /users/{id}"), ("s1", "GET /api/orders"), ("s1", "GET /deep/a/b/{x}")]
PATHS = ["/users/{id}", "/v1/users/{id}", "/${base}/users/{id}", "/orders", "/${base}/orders/${slug}", "/a/b/7", "/", "x/y", "/v1", "/deep"]


def cut(path):
    return [s for s in path.split("/") if s]


def path_of(op, key, captured, absolute, selections, prefixes):
    own = op.partition(" ")[2] or "/"
    if captured:
        parts = cut(own)
        return "/" + "/".join(parts[1:] if parts and re.match(r"^\$\{[^}]*\}$", parts[0]) else parts)
    if absolute or not own.startswith("/"):
        return own
    mine = sorted((r[3], r[2]) for r in selections if (r[0], r[1]) == key and r[2])
    fits = sorted((len(cut(r[1])), r[3], r[2]) for r in prefixes if r[0] == key[0] and r[1] and cut(own)[: len(cut(r[1]))] == cut(r[1]))
    base = mine[-1][1] if mine else fits[-1][2] if fits else None
    if base is None:
        return own
    path = (re.sub("^([a-z]+:)?//[^/]*", "", base) if "//" in base else base).rstrip("/")
    return path + own if path and cut(own)[: len(cut(path))] != cut(path) else own


def verdict(op):
    method, _, path = op.partition(" ")
    wild = lambda p: ["*" if re.fullmatch(r"\$?\{[^{}]*\}|\d+", s) else s for s in cut(p)]
    if cut(path) and cut(path)[0].startswith("${"):
        return "unresolved", "partial", None
    docs = [(d, d.split(" ")[0], wild(d.split(" ")[1])) for _, d in SPEC]
    end = lambda a, b: 0 < len(a) < len(b) and b[-len(a) :] == a
    for reason, status, test in (("documented", "documented", lambda m, p: m == method and p == wild(path)), ("suffix-verify", "unresolved", lambda m, p: m == method and (end(p, wild(path)) or end(wild(path), p))), ("undocumented-method", "shadow", lambda m, p: p == wild(path))):
        hit = next((d for d, m, p in docs if test(m, p)), None)
        if hit:
            return status, reason, hit
    return "shadow", "undocumented-path", None


def test_verdicts(spark):
    rng = random.Random(9)
    ops = [f"{m} {p}" for m in ("GET", "POST", "DELETE") for p in PATHS]
    seen = [(rng.choice([1, 1, 1, 2, 3]), f"h{k % 45}", ops[k % 45 % len(ops)], "h.example" if rng.random() < 0.03 else None, rng.choice(["static"] * 12 + ["capture", None])) for k in range(400)]
    selections = [(1, f"h{rng.randrange(45)}", rng.choice(["https://a.example/v1", "/api", "/api/", None]), k) for k in range(12)]
    prefixes = [(1, "/users", "https://b.example:8/v1/", 1), (1, "/", "/api", 2), (2, "/a/b/", "//c.example/deep", 3), (2, "/a", "/no", 4), (2, "/a/b", "/newer", 1), (2, "", "/never", 9)]
    documented = [(s, "ref", k, op) for s in (1, 2) for k, (_, op) in enumerate(SPEC)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    args = (frame(seen, "session long, finding_hash string, operation string, host string, engine string"), frame(selections, "session long, finding_hash string, base_url string, recency long"), frame(prefixes, "session long, path_prefix string, base_url string, recency long"), frame(documented, "session long, spec_ref string, ord int, operation string"))
    want = {}
    for s, h, op, _, _ in seen:
        if s < 3:
            captured = any(x[4] == "capture" for x in seen if x[:2] == (s, h))
            absolute = any(x[3] for x in seen if x[0] == s and x[2] == op)
            want[s, h] = verdict(op.split(" ")[0] + " " + path_of(op, (s, h), captured, absolute, selections, prefixes))
    new = sessions.verdicts(*args)
    assert {(r.session, r.finding_hash): (r.status, r.reason, r.matched) for r in new.collect()} == want
    assert {v[1] for v in want.values()} >= {"documented", "suffix-verify", "undocumented-method", "undocumented-path", "partial"}

    old = frame([(1, seen[0][1], "shadow", "old", None, "r0"), (9, "gone", "shadow", "old", None, "r0")], "session long, finding_hash string, status string, reason string, matched string, spec_ref string")
    once = sessions.upserted(old, new).cache()
    twice = sessions.upserted(once.drop("changed"), new)
    rows = lambda df: sorted(map(str, df.drop("changed").collect()))
    assert rows(once) == rows(twice) and twice.where("changed").isEmpty()
    assert once.where("session = 9 AND reason = 'old' AND NOT changed").count() == 1 and once.count() == len(want | {(1, seen[0][1]): 0, (9, "gone"): 0})
    bare = frame([(1, "empty", None, None)], "session long, spec_ref string, ord int, operation string")
    assert {r.reason for r in sessions.verdicts(*args[:3], bare).collect()} <= {"undocumented-path", "partial"}
    assert sessions.verdicts(args[0].limit(0), *args[1:]).count() == 0
