"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_measures(text):
    held = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(held[i : i + 3]) for i in range(len(held) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    failed = len(held) < 50 or 100 * len(covered) > 50 * len(held)
    return len(held), sum(map(len, held)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    held = words(lower)
    size = min(3, len(held))
    shingles = [" ".join(held[i : i + size]) for i in range(len(held) - size + 1)] if held else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id of each row's component, for (id, fingerprint) rows; ids may be null."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(prints[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(prints))]


def shingles(text):
    """The different runs of five words, or all words of a shorter text."""
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    held = lower.split()
    size = min(5, len(held))
    return {tuple(held[i : i + size]) for i in range(len(held) - size + 1)} if held else set()


def near_copies(rows):
    """Smallest id of each row's component over all pairs at 0.8 or more."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 10 * len(a & b) >= 8 * len(a | b):
            parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return [min(groups[find(i)]) for i in range(len(rows))]


def without_repeats(docs, size=20):
    """(id, words, removed, kept) of different (id, text) rows, in order of id."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        held = words(text)
        gone = set()
        for i in range(len(held) - size + 1):
            window = tuple(held[i : i + size])
            if window in seen:
                gone |= set(range(i, i + size))
            seen.add(window)
        out.append((doc, len(held), len(gone), " ".join(w for i, w in enumerate(held) if i not in gone)))
    return out


def top_k(vectors, every, k):
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (query, q) in enumerate(held):
        if query % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(held) if a != b)[:k]
            out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def backoff_scores(tokens, backoff):
    single, pair = Counter(), Counter()
    for ids in tokens:
        single.update(ids)
        pair.update(zip(ids, ids[1:]))
    total, kinds, out = sum(single.values()), len(single), []
    for ids in tokens:
        own, own_pair, score = Counter(ids), Counter(zip(ids, ids[1:])), 0.0
        for k, token in enumerate(ids):
            back = math.log((single[token] - own[token] + 1) / (total - len(ids) + kinds))
            both = (ids[k - 1], token) if k else None
            left = pair[both] - own_pair[both] if k else 0
            if left > 0:
                score += math.log(left / (single[both[0]] - own[both[0]]))
            else:
                score += back + (math.log(backoff) if k else 0)
        out.append(score / max(1, len(ids)))
    return out
