"""The correlation query against a nested loop over all templates and all requests."""

import re
from collections import defaultdict

from basalt.plans import models
from basalt.sources.views import endpoints

PARAMETER = re.compile(r"(?:\{[^{}]*\}|\$\{[^{}]*\}|:[A-Za-z_][A-Za-z0-9_]*)\Z")


def nested_loop(templates, urls):
    segments = lambda path: [s for s in path.split("/") if s]
    of_finding = defaultdict(set)
    for url in urls:
        seen, best = segments(re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", url)[1]), []
        for finding, path in templates:
            tail = segments(path)
            opened = bool(tail) and re.match(r"\$\{[^{}]*\}\Z", tail[0])
            tail = tail[1:] if opened else tail
            constants = [s for s in tail if not PARAMETER.match(s)]
            window = seen[len(seen) - len(tail) :] if len(seen) >= len(tail) else None
            if constants and window is not None and (opened or len(seen) == len(tail)) and all(PARAMETER.match(a) or a == b for a, b in zip(tail, window, strict=True)):
                best.append((len(constants), len(tail) - len(seen), finding))
        top = [f for c, a, f in best if (c, a) == max(x[:2] for x in best)]
        if len(top) == 1:
            of_finding[top[0]].add(url)
    return {(f, min(u)) for f, u in of_finding.items() if len(u) == 1}


def test_all_requests_are_observed(spark, tmp_path):
    urls = ["https://a.example/fr/1", "https://a.example/de/one", "https://a.example/de/two", "https://a.example/es/x/y", "https://b.example/es/x/y?q=1", "https://a.example/it/12/z", "https://a.example/it/13/z", "https://c.example/only"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    templates = {(r.finding_hash, re.sub("^GET ", "", r.operation)) for r in endpoints(spark, str(tmp_path)).collect()}
    want = nested_loop(templates, urls)
    got = models.c10_correlate(spark, str(tmp_path)).collect()
    assert want and {(r.finding, r.url) for r in got} == want and len(got) == len(want)


def test_small(spark, small):
    ep = endpoints(spark, small).collect()
    want = nested_loop({(r.finding_hash, re.sub("^GET ", "", r.operation)) for r in ep}, {r.url for r in ep})
    assert {(r.finding, r.url) for r in models.c10_correlate(spark, small).collect()} == want
