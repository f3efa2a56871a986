"""The view of findings against a plain reading of the same rows."""

import random

from basalt.operators import views


def tables(spark, rng):
    runs = [(r, r % 3, (r % 2) if r < 6 else None, "capture" if r % 3 else "platform", "ref" if r % 2 else None) for r in range(8)]
    findings = list({(rng.randrange(8), f"h{rng.randrange(12)}") for _ in range(70)})
    findings = [(r, h, "secret" if h in ("h1", "h2") else "endpoint", f"v{int(h[1:]) % 4}", "p") for r, h in findings]
    occurrences = [(r, h, rng.choice([None, "", "a.io", "b.io"]), rng.choice([None, "s1", "s2"]), rng.choice([None, 3, 9]), 10, "proof", f"o{k:03}", rng.choice([None, "a1", "a2", "gone"])) for k in range(300) for r, h in [(rng.randrange(8), f"h{rng.randrange(12)}")]]
    assets = [(r, a, f"https://{a}.io", "blob" if (r + len(a)) % 2 or a == "a1" else None) for r in range(8) for a in ("a1", "a2")]
    triage = [(s, h, "confirmed") for s in range(3) for h in ("h1", "h3")]
    verdicts = [(s, h, "shadow", "undocumented-path", "GET /Matched") for s in range(2) for h in ("h4", "h5")]
    frame = spark.createDataFrame
    return (runs, findings, occurrences, assets, triage, verdicts), (
        frame(runs, "run long, session long, engagement long, origin string, input_ref string"),
        frame(findings, "run long, finding_hash string, type string, value string, path string"),
        frame(occurrences, "run long, finding_hash string, host string, source_path string, offset_start long, offset_end long, evidence string, occurrence_hash string, asset string"),
        frame(assets, "run long, asset string, url string, input_ref string"),
        frame(triage, "session long, finding_hash string, status string"),
        frame(verdicts, "session long, finding_hash string, status string, reason string, matched string"),
    )


def test_as_read_plainly(spark):
    rows, (runs, findings, occurrences, assets, triage, verdicts) = tables(spark, random.Random(6))
    seen = views.occurrence_view(findings, occurrences, runs, assets)
    view = views.findings_view(findings, seen, triage, verdicts, runs)
    got = {(r.run, r.finding_hash): r for r in view.collect()}
    held = {r[0]: r for r in rows[0]}
    refs = {(r, a): ref for r, a, _, ref in rows[3]}
    order = {}
    for r, h, t, v, _ in sorted(rows[1], key=lambda f: (f[0], f[2], f[3], f[1])):
        order[r] = order.get(r, 0) + 1
        own = [o for o in rows[2] if o[:2] == (r, h)]
        x = got[r, h]
        assert x.place == order[r]
        assert x.triage == ("confirmed" if h in ("h1", "h3") else None) and x["class"] == ("shadow" if h in ("h4", "h5") and held[r][1] < 2 else None)
        assert x.occurrences == len(own) and x.hosts == sorted({o[2] for o in own if o[2]})
        blob = any(o[4] is not None and (refs.get((r, o[8])) if o[8] else held[r][4]) for o in own)
        assert x.revealable == (t == "secret" and blob)
        group = held[r][2]
        others = [held[f[0]][3] for f in rows[1] if f[1] == h and f[0] != r and held[f[0]][2] == group]
        want = (None, None) if group is None else (others.count("capture"), others.count("platform"))
        assert (x.sightings_capture, x.sightings_platform) == want
    assert set(got) == {f[:2] for f in rows[1]}
    listed = {}
    for r in sorted(seen.collect(), key=lambda r: (r.run, r.finding_hash, r.place)):
        listed.setdefault((r.run, r.finding_hash), []).append((r.source_path, r.offset_start, r.evidence))
    types = {f[:2]: f[2] for f in rows[1]}
    for key, found in listed.items():
        own = sorted((o for o in rows[2] if o[:2] == key), key=lambda o: (o[3] or "", o[4] or 0, o[7]))
        assert found == [(o[3], o[4], None if types[key] == "secret" else o[6]) for o in own]
    # facets: any value within one, all of several
    chosen = {"type": ["endpoint"], "triage": [views.UNTRIAGED], "host": ["a.io", "nowhere"], "class": []}
    shown = {(r.run, r.finding_hash) for r in views.visible(view, chosen).collect()}
    assert shown == {k for k, x in got.items() if x.type == "endpoint" and x.triage is None and "a.io" in x.hosts} and shown
    assert {(r.run, r.finding_hash) for r in views.visible(view, {}, "matched").collect()} == {k for k, x in got.items() if x["class"]}
    counts = {(r.facet, r.value): r.n for r in views.facet_counts(view).collect()}
    assert counts["host", "a.io"] == sum("a.io" in x.hosts for x in got.values()) and counts["class", views.UNCLASSIFIED] == sum(x["class"] is None for x in got.values())
    nothing = views.occurrence_view(findings.limit(0), occurrences, runs, assets)
    assert nothing.count() == 0 and views.findings_view(findings.limit(0), nothing, triage, verdicts, runs).count() == 0
