"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(docs, size=4):
    out = {}
    for doc, text in docs:
        w = WORD.findall(lower(text))
        out[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def near_groups(docs, size=4, percent=80):
    """doc -> (number of shingles, component), by all pairs that share a shingle."""
    sets = shingle_sets(docs, size)
    by = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            by[x].append(doc)
    common = Counter()
    for held in by.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, size=50):
    """doc -> (words, removed, kept words), for windows of ``size`` words that start in a document of smaller id too."""
    first = {}
    held = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(held):
        w = held[d]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, w in held.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out
