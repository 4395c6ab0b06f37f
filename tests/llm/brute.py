"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def hits(text, items):
    """(n_words, n_hit, ids of items with windows in the text)."""
    words = WORD.findall((text or "").translate(LOWER))
    marked, found = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    marked.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(marked), sorted(found)


def shingle_bag(text):
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - 4) if words else 0
    count, bag = defaultdict(int), set()
    for i in range(n):
        s = tuple(words[i : i + 5])
        bag.add((s, count[s]))
        count[s] += 1
    return bag


def near_classes(rows, least=0.8):
    """{key: least key of its class} of (key, text)."""
    bags, up = [shingle_bag(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(bags[a] & bags[b])
        if both >= least * len(bags[a] | bags[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    classes = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        classes[find(i)].append(k)
    return {k: min(v) for v in classes.values() for k in v}


def repeats(rows, span=50):
    """{key: (n_bytes, n_removed, n_spans, digest, kept)} of (key, text)."""
    out, first = {}, {}
    bodies = sorted((k, (t or "").encode()) for k, t in rows)
    for k, b in bodies:
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], k)
    for k, b in bodies:
        mark = [False] * len(b)
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < k:
                mark[i : i + span] = [True] * span
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        spans = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        out[k] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out
