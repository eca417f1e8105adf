"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def longest_match(word: bytes, vocabulary: set[bytes], most: int | None = None) -> int | None:
    i = n = 0
    most = most or max(map(len, vocabulary), default=0)
    while i < len(word):
        j = next((j for j in range(min(len(word), i + most), i, -1) if word[i:j] in vocabulary), None)
        if j is None:
            return None
        i, n = j, n + 1
    return n


def without_repeats(rows, window=20):
    """id -> (words, which are kept)"""
    docs = sorted((i, WORD.findall(t or "")) for i, t in rows)
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = {}
    for i, w in docs:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                keep[s : s + window] = [False] * window
        out[i] = (w, keep)
    return out


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near_duplicates(rows):
    """id -> (shingles, component, kept)"""
    sets, owners = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in owners[x]).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def quality(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
