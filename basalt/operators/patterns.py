"""Many patterns against many texts: an automaton over the literals that patterns require finds the few worth trying.

A pattern is RE2 syntax. Of each the longest run of characters that every match must contain is taken; an
Aho-Corasick automaton over these runs goes once over a text, and only patterns whose run occurs are tried, each
on all its texts of a batch at once. Runs and texts are compared by their case folding, which no two characters
that match each other without regard to case tell apart. Patterns without such a run of LEAST characters are
tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc

#: Runs shorter than this would be found nearly everywhere.
LEAST = 3
_REPEAT = re.compile(r"[*+?]\??|\{(\d+)(?:,\d*)?\}\??")


def _atoms(pattern: str) -> Iterator[tuple[str, str]]:
    """The pattern's pieces in order: (kind, text), kind one of char, open, close, or, class, repeat."""
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find("\\E", i)
                stop = n if end < 0 else end
                yield from (("char", x) for x in pattern[i + 2 : stop])
                i = min(n, stop + 2)
            elif d in "xpP":
                end = pattern.find("}", i) if pattern[i + 2 : i + 3] == "{" else i + (3 if d == "x" else 2)
                end = n - 1 if end < 0 else end
                yield "class", pattern[i : end + 1]
                i = end + 1
            else:
                yield ("class" if d.isalnum() else "char"), (pattern[i : i + 2] if d.isalnum() else d)
                i += 2
        elif c == "[":
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            j += pattern[j : j + 1] == "]"
            while j < n and pattern[j] != "]":
                named = pattern.startswith("[:", j) and (end := pattern.find(":]", j)) >= 0
                j = end + 2 if named else j + 1 + (pattern[j] == "\\")
            yield "class", pattern[i : j + 1]
            i = j + 1
        elif c == "(":
            m = re.compile(r"\(\?P?<\w+>|\(\?[A-Za-z-]*[:)]|\(").match(pattern, i)
            yield ("class" if m[0].endswith(")") else "open"), m[0]
            i = m.end()
        elif c == ")" or c == "|":
            yield ("close" if c == ")" else "or"), c
            i += 1
        elif m := _REPEAT.match(pattern, i):
            yield "repeat", m[0]
            i = m.end()
        elif c in ".^$":
            yield "class", c
            i += 1
        else:
            yield "char", c
            i += 1


def required_run(pattern: str) -> str:
    """The longest run of characters outside of groups that every match contains; empty if none is certain."""
    best = run = ""
    depth = 0
    for kind, text in _atoms(pattern):
        if kind == "or" and not depth:
            return ""
        depth += (kind == "open") - (kind == "close")
        if kind == "char" and not depth:
            run += text
            continue
        if kind == "repeat" and not depth and (text[0] in "*?" or re.match(r"\{0+[,}]", text)):
            run = run[:-1]  # what it repeats may be absent
        best, run = max(best, run, key=len), ""
    return max(best, run, key=len)


def named_groups(pattern: str) -> tuple[str, int]:
    """The pattern, in a group g0, with its groups named g1, g2 ..., and their number."""
    out, n = [], 0
    for kind, text in _raw(pattern):
        if kind == "open" and (text == "(" or "<" in text):
            n += 1
            text = f"(?P<g{n}>"
        out.append(text)
    return f"(?P<g0>{''.join(out)})", n


def _raw(pattern: str) -> Iterator[tuple[str, str]]:
    """_atoms() with every piece as it was written."""
    at = 0
    for kind, text in _atoms(pattern):
        if kind == "char":
            if pattern.startswith("\\Q", at):
                at_text = pattern[at : at + 2]
                yield "class", at_text
                at += 2
            if pattern.startswith("\\E", at):
                yield "class", "\\E"
                at += 2
            written = pattern[at : at + 2] if pattern[at] == "\\" and pattern[at + 1 : at + 2] == text and not text.isalnum() else text
            yield kind, written
            at += len(written)
        else:
            if pattern.startswith("\\E", at) and not text.startswith("\\E"):
                yield "class", "\\E"
                at += 2
            yield kind, text
            at += len(text)
    if at < len(pattern):
        yield "class", pattern[at:]


def accepted(pattern: str | None) -> bool:
    """Whether RE2 takes the pattern; it has no lookaround and no back references."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern=f"(?i){pattern or ''}")
    except pa.ArrowInvalid:
        return False
    return True


@dataclass
class Tried:
    """One pattern of a set."""

    pattern: str
    groups: int = 0
    source: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        named, self.groups = named_groups(self.pattern)
        self.source = f"(?i){named}"
        if not accepted(named):  # a form that the naming doesn't know; then without its groups
            self.source, self.groups = f"(?i)(?P<g0>{self.pattern})", 0

    def search(self, texts: pa.Array) -> pa.Array:
        """A struct of g0, g1, ... for each text; null if there is no match. A group that took no part is empty."""
        return pc.extract_regex(texts, self.source)


class _Met(dict):
    """Patterns as they are tried, each made when a text first meets it."""

    def __init__(self, patterns: dict[int, str]):
        super().__init__()
        self.patterns = patterns

    def __missing__(self, number: int) -> Tried:
        self[number] = one = Tried(self.patterns[number])
        return one


class PatternSet:
    """Patterns by number, and which of them a text may match."""

    def __init__(self, patterns: dict[int, str]):
        import ahocorasick

        self.tried = _Met(patterns)
        self.always: list[int] = []
        self.runs: dict[str, list[int]] = {}
        for k, p in patterns.items():
            run = required_run(p).casefold()
            if len(run) >= LEAST:
                self.runs.setdefault(run, []).append(k)
            else:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for run in self.runs:
            self.automaton.add_word(run, run)
        if self.runs:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> set[int]:
        found = {run for _, run in self.automaton.iter(text.casefold())} if self.runs else set()
        return {k for run in found for k in self.runs[run]} | set(self.always)


class NameSet:
    """Names that are looked for as whole words: at an end that is a word character no word character may follow."""

    def __init__(self, names: dict[str, list[int]]):
        import ahocorasick

        self.names = names
        self.automaton = ahocorasick.Automaton()
        for name in names:
            self.automaton.add_word(name, name)
        if names:
            self.automaton.make_automaton()

    @staticmethod
    def _word(c: str) -> bool:
        return c.isascii() and (c.isalnum() or c == "_")

    def found(self, text: str) -> set[str]:
        out: set[str] = set()
        for end, name in self.automaton.iter(text) if self.names else ():
            if name in out:
                continue
            before, after = text[end - len(name) : end - len(name) + 1] if end >= len(name) else "", text[end + 1 : end + 2]
            if not (self._word(name[0]) and before and self._word(before) or self._word(name[-1]) and after and self._word(after)):
                out.add(name)
        return out
