"""Imports against a plain search, with names passed on in chains and circles."""

import posixpath
import random

from basalt.operators import modules


def plain(imports, exports, passed):
    own, on = {}, {}
    for s, m, n, v, o in sorted(exports, key=lambda r: r[-1]):
        own.setdefault((s, m, n), v)
    for s, m, n, spec, imp in passed:
        on.setdefault((s, m, n), []).append((spec, imp))

    def target(s, importer, spec, name):
        if not spec.startswith("."):
            return None
        path = posixpath.normpath(posixpath.join(posixpath.dirname(importer), spec))
        for rank, e in enumerate(modules.ENDINGS):
            if (s, path + e, name) in own or (s, path + e, name) in on:
                return rank, path + e, name
        return None

    def value(s, m, n, seen):
        if (s, m, n) in own:
            return own[s, m, n]
        if (s, m, n) in seen:
            return None
        found = [t for spec, imp in on.get((s, m, n), []) if (t := target(s, m, spec, imp))]
        return value(s, *min(found)[1:], seen | {(s, m, n)}) if found else None

    out = {}
    for s, importer, local, imp, spec, _ in sorted(imports, key=lambda r: r[-1]):
        t = target(s, importer, spec, imp)
        v = value(s, *t[1:], frozenset()) if t else None
        if v is not None:
            out[s, importer, local] = v
    return out


def test_against_plain_search(spark):
    rng = random.Random(4)
    path = lambda: rng.choice(["src/", "src/a/", ""]) + rng.choice("xyz") + rng.choice(modules.ENDINGS)
    spec = lambda: rng.choice(["./x", "../y", "./a/z", "./y.js", "pkg", "../../x", "./z/index.js", ".."])
    name = lambda: rng.choice("pqrst")
    exports = [(rng.choice([1, None]), path(), name(), f"v{k}", k) for k in range(60)]
    passed = [(rng.choice([1, None]), path(), name(), spec(), name()) for _ in range(300)]
    imports = [(rng.choice([1, None]), path(), rng.choice("lm"), name(), spec(), k) for k in range(600)]
    chain = [(2, f"c{k}.js", "n", f"./c{k + 1}", "n") for k in range(20)]
    circle = [(3, "a.js", "n", "./b", "n"), (3, "b.js", "n", "./a", "n")]
    more = [(2, "main.js", "l", "n", "./c0", 1), (3, "main.js", "l", "n", "./a", 1)]
    exports += [(2, "c20.js", "n", "end", 99)]
    x = spark.createDataFrame(exports, "build long, module string, name string, value string, ord long")
    p = spark.createDataFrame(passed + chain + circle, "build long, module string, name string, specifier string, imported string")
    i = spark.createDataFrame(imports + more, "build long, importer string, local string, imported string, specifier string, ord long")
    got = {(r.build, r.importer, r.local): r.value for r in modules.resolved(i, x, p, ("build",)).collect()}
    want = plain(imports + more, exports, passed + chain + circle)
    assert got == want and got[2, "main.js", "l"] == "end" and (3, "main.js", "l") not in got and len(got) > 40
    assert modules.resolved(i.limit(0), x, p, ("build",)).count() == 0
    alone = {(r.build, r.importer, r.local): r.value for r in modules.resolved(i, x, None, ("build",)).collect()}
    assert alone == plain(imports + more, exports, [])
