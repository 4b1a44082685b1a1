"""Brute-force versions of the operators, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def union(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    counts = Counter(k for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def components_of(fps, radius=2):
    ids = list(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i:] if (fps[a] ^ fps[b]).bit_count() <= radius]
    return union(ids, pairs)


def substrings(rows, window=35):
    """[(n_words, n_removed, sha)] for texts."""
    words = [(t or "").encode().split() for t in rows]
    counts = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def contamination(rows, items, window=10):
    owners = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            owners[tuple(w[k : k + window])].add(item)
    lengths = {len(w) for w in owners}
    out = []
    for text in rows:
        w, hit, found = WORDS.findall(lower(text)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    found |= owners[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), sha, bool(hit)))
    return out


def licences(text):
    w, starts, labels = WORDS.findall(lower(text)), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def cosines(vectors, threshold=0.95):
    """(links by position, component by id)."""
    good = [i for i, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(vectors[i][1], float) / np.linalg.norm(np.array(vectors[i][1], float)) for i in good}
    pairs = [(a, b) for n, a in enumerate(good) for b in good[n + 1 :] if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold]
    links = Counter(x for p in pairs for x in p)
    comp = union(range(len(vectors)), pairs)
    ids = defaultdict(list)
    for i, c in comp.items():
        if vectors[i][0] is not None:
            ids[c].append(vectors[i][0])
    return [(links[i], min(ids[comp[i]], default=None)) for i in range(len(vectors))]


def crc(text):
    return zlib.crc32((text or "").encode())


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(texts):
    """Component of each key of texts: five-word shingles, Jaccard 0.8 or more."""
    sets = {k: shingles(t) for k, t in texts.items()}
    ids = list(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return union(ids, pairs)
