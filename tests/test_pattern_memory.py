"""A set of patterns prepares only those that a text meets."""

import random

import pyarrow as pa

from basalt.operators import patterns


def test_only_met_patterns_are_prepared():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    names = [word() for _ in range(3000)]
    held = patterns.PatternSet({k: f"{w}([0-9])" for k, w in enumerate(names)})
    assert len(held.tried) == 0
    text = f"{names[5]}7 {names[9].upper()}8 {names[11]}x"
    found = held.candidates(text)
    assert found == {5, 9, 11} and len(held.tried) == 0
    assert {k for k in found if held.tried[k].search(pa.array([text]))[0].is_valid} == {5, 9}
    assert set(held.tried) == {5, 9, 11}
