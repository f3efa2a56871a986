"""Plain versions of the operators' results, one document at a time, that tests hold the Spark queries against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text):
    return WORD.findall(text or "")


def base_secrets(text):
    """(start, kind, end) of the base findings, and the number of each kind."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found), [sum(k == i for _, k, _ in found) for i in range(3)]


def spans_text(found):
    return ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, k, b in found)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def held(doc_id, mod, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == rest


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_dup(rows, width=3, low=85, of=100):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups, of_shingle = defaultdict(list), defaultdict(set)
    for d, s in sets.items():
        if s:
            groups[s].append(d)
    reps = {min(g): s for s, g in groups.items()}
    for g in groups.values():
        for d in g:
            parent[d] = min(g)
    for d, s in reps.items():
        for x in s:
            of_shingle[x].add(d)
    tally = Counter(p for ds in of_shingle.values() if len(ds) > 1 for p in combinations(sorted(ds), 2))
    for (a, b), both in tally.items():
        if of * both >= low * (len(reps[a]) + len(reps[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(cover)))
        out.append((len(b), sum(cover), runs, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c))))
    return out


def unigram(rows):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}; the end of a text is None."""
    token = {d: [*words((t or "").translate(LOWER)), None] for d, t in rows}
    c = Counter(x for d, ts in token.items() if not held(d, 7, 2) for x in ts)
    n, v = sum(c.values()), len(c)
    return {d: (len(ts), sum(c[x] > 0 for x in ts), n, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in token.items()}


def benchmark_hits(rows, items, low=80, of=100):
    """{(doc_id, item_id)} where the item lies at one place of the text with enough equal words."""
    out = set()
    ws = {i: words((t or "").translate(LOWER)) for i, t in items}
    number = {}
    code = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    coded = {i: code(w) for i, w in ws.items() if len(w) >= 4}
    for d, t in rows:
        own = code(words((t or "").translate(LOWER)))
        for i, w in coded.items():
            common = np.isin(own, w)
            if common.sum() * of < low * len(w):
                continue
            shifts = Counter()
            places = defaultdict(list)
            for k, x in enumerate(w):
                places[x].append(k)
            for at in np.flatnonzero(common):
                for k in places[own[at]]:
                    shifts[at - k] += 1
            if shifts and max(shifts.values()) * of >= low * len(w):
                out.add((d, i))
    return out
