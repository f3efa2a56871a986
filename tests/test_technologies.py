"""Sets of many patterns and names against plain search, and detection rules."""

import json
import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from basalt.operators import fingerprints, patterns

RULES = "tech string, surface string, key string, value string, ord long"
SIGNALS = "host string, surface string, key string, value string, ord long"


@pytest.mark.parametrize(
    ("pattern", "run"),
    [(r'href="/a"([^>]*)>', 'href="/a"'), ("a|b", ""), (r"jquery[.-]([\d.]*\d)[^/]*\.js", "jquery"), ("(?:foo|bar)bazz?qu", "baz"), ("^x{2,}abc\\.def$", "abc.def"), (r"\Qa.b(\Ex(y)", "a.b(x"), (r"[\]a(]b(c)", "b"), ("ab{0}cde", "cde"), ("ab{0,2}c", "a"), ("abc+def", "abc"), (r"\x41bc\pLde", "bc"), ("", ""), ("é+cole", "cole")],
)
def test_required_run(pattern, run):
    assert patterns.required_run(pattern) == run


def test_groups_keep_their_numbers():
    for pattern, text, want in [(r"(a)(?:b)(?P<n>c)", "abc", ["a", "c"]), (r"[(](x)\(", "(x(", ["x"]), (r"\Q(\E(y)?", "(", [""]), (r"(a(b)?)", "a", ["a", ""])]:
        one = patterns.Tried(pattern)
        got = one.search(pa.array([text])).to_pylist()[0]
        assert [got[f"g{k + 1}"] for k in range(one.groups)] == want


def test_candidates_lose_no_match():
    rng = random.Random(6)
    pieces = ["ab", "Abc", "K", "ſt", "é", "É", "x?", "y*", "(cd)", "(e|fg)", "[h-j]", "\\.", "\\d", "z{2}", "q{0,1}", "^", "$", "(?:mno)?", "wor", "ld", "\\bword\\b"]
    made = {k: "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) for k in range(300)}
    made = {k: p for k, p in made.items() if patterns.accepted(p)}
    held = patterns.PatternSet(made)
    parts = ["ab", "ABC", "abc", "k", "K", "st", "ſt", "é", "É", "cd", "e", "fg", "h", ".", "7", "zz", "mno", "world", " word ", "WOR"]
    hits = 0
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        want = {k for k, p in made.items() if pc.match_substring_regex(pa.array([text]), pattern="(?i)" + p)[0].as_py()}
        some = held.candidates(text)
        assert want <= some
        assert {k for k in some if held.tried[k].search(pa.array([text]))[0].is_valid} == want
        hits += len(want)
    assert hits > 500 and len(held.runs) > 20


def test_names_are_whole_words():
    rng = random.Random(2)
    names = {"$nuxt": [1], "React.version": [2], "__NEXT": [3], "longword": [4], "a_b.": [5]}
    held = patterns.NameSet(names)
    word = lambda c: re.match("[A-Za-z0-9_]", c) is not None
    bounded = {n: ("\\b" if word(n[0]) else "") + re.escape(n) + ("\\b" if word(n[-1]) else "") for n in names}
    for _ in range(3000):
        text = "".join(rng.choice([*names, "x", ".", " ", "_", "é", "$", "React"]) for _ in range(rng.randrange(6)))
        assert held.found(text) == {n for n, p in bounded.items() if re.search(p, text, re.ASCII)}, text


def detected(spark, rules, signals, **more):
    parsed = fingerprints.parsed_rules(spark.createDataFrame(rules, RULES))
    return {(r.host, r.tech): r for r in fingerprints.detections(spark.createDataFrame(signals, SIGNALS), parsed, **more).collect()}


def test_version_of_the_surest_rule(spark):
    rules = [("t", "script_src", None, "a([0-9])\\;version:\\1\\;confidence:30", 1), ("t", "script_src", None, "b([0-9])\\;version:\\1\\;confidence:50", 2), ("t", "scripts", None, "c([0-9])\\;version:\\1\\;confidence:50", 3), ("u", "scripts", None, "\\;version:\\0?x:y", 4), ("w", "scripts", None, "c\\;version:v\\0", 5)]
    signals = [("h", "script_src", None, "a1 b2", 1), ("h", "scripts", None, "C3", 2), ("h", "script_src", None, "a4", 3)]
    got = detected(spark, rules, signals)
    assert (got["h", "t"].version, got["h", "t"].other_versions, got["h", "t"].confidence) == ("2", ["1", "4", "3"], 100)
    assert got["h", "t"].evidence == ["script_src: a1", "script_src: a4", "script_src: b2", "scripts: C3"]
    assert (got["h", "u"].version, got["h", "u"].evidence, got["h", "w"].version) == ("y", ["scripts: <scripts match>"], "v")


def test_surfaces_and_ceiling(spark):
    rules = [("g", "js", "window.__app", "\\;confidence:40", 1), ("g", "js", "$other", "\\;confidence:40", 2), ("g", "js", "Short", "", 3), ("m", "meta", "generator", "word", 4), ("n", "meta", "author", "x", 5), ("c", "cookie", "sid", "", 6), ("e", "header", "via", "", 7), ("bad", "scripts", None, "a(?=b)", 8)]
    signals = [(h, s, k, v, o) for h in ("h", None) for s, k, v, o in [("scripts", None, "window.__app $other Short ab", 1), ("scripts", None, "window.__app", 2), ("meta", "generator", "A Word", 3), ("meta", "author", "x", 4), ("cookie", "sid", None, 5), ("header", "via", "", 6), ("scripts", None, None, 7), ("odd", None, "x", 8)]]
    got = detected(spark, rules, signals)
    assert {k: r.confidence for k, r in got.items()} == {(h, t): c for h in ("h", None) for t, c in (("g", 50), ("m", 100), ("c", 100))}
    parsed = fingerprints.parsed_rules(spark.createDataFrame(rules, RULES))
    assert {r.surface: (r.accepted, r.rejected, r.passed_over) for r in fingerprints.rejects(parsed).collect()}["scripts"] == (0, 1, 0)
    assert {r.surface: (r.accepted, r.rejected, r.passed_over) for r in fingerprints.rejects(parsed).collect()}["js"] == (2, 0, 1)
    assert detected(spark, rules[:0], signals) == {} and detected(spark, rules, signals[:0]) == {}


def test_any_number_of_blocks_gives_the_same(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(4))
    rules = [(f"t{k % 17}", rng.choice(["scripts", "script_src"]), None, f"{word()}([a-c])\\;version:\\1\\;confidence:{k % 5}", k) for k in range(150)] + [(f"t{k}", "js", word() + "_" + word(), "", 200 + k) for k in range(60)]
    signals = [(f"h{k % 9}", rng.choice(["scripts", "script_src"]), None, " ".join(word() + rng.choice(["_", " ", ""]) + word() for _ in range(60)), k) for k in range(80)]
    shape = lambda d: {k: tuple(r) for k, r in d.items()}
    one = shape(detected(spark, rules, signals))
    assert one and one == shape(detected(spark, rules, signals, block_bytes=2000))


def test_data_set(spark):
    text = json.dumps({"T": {"cats": [1, 6], "headers": {"Server": "n\\;confidence:30"}, "scriptSrc": ["s.js"], "js": {"window.T": ""}}, "U": {"meta": {"Generator": "u"}, "cookies": {"Sid": ""}, "implies": "T"}})
    rows = fingerprints.dataset_rules(spark.createDataFrame([(text,)], "text string")).orderBy("ord").collect()
    assert [(r.tech, r.surface, r.key, r.value, r.categories) for r in rows] == [("T", "header", "server", "n\\;confidence:30", [1, 6]), ("T", "script_src", None, "s.js", [1, 6]), ("T", "js", "window.T", "", [1, 6]), ("U", "cookie", "sid", "", []), ("U", "meta", "generator", "u", [])]
    none = spark.createDataFrame([(None,), ("{}",), ("no json",)], "text string")
    assert fingerprints.dataset_rules(none).count() == 0


def test_no_plan_joins_on_the_surface(spark):
    rules = fingerprints.parsed_rules(spark.createDataFrame([("t", "scripts", None, "abc", 1)], RULES))
    found = fingerprints.detections(spark.createDataFrame([("h", "scripts", None, "abc", 1)], SIGNALS), rules)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select(F.sum("confidence")).first()[0] == 100
