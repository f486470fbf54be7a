"""Plain-Python counterparts of the training-data operators, for small tables."""

import hashlib
import re
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(names, links):
    """The least name reachable from each."""
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in names}


def fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint_groups(texts, bits=2):
    """texts: {id: text}; {id: (fingerprint, least id reachable)}."""
    fps = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= bits]
    found = components(ids, links)
    return {i: (fps[i], found[i]) for i in ids}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts, items, size=10):
    """{id: (n_words, n_hit, item ids)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for key, text in texts.items():
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out[key] = (len(w), len(hit), sorted(found))
    return out


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 12), ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16)]


def base_spans(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


def without_repeats(texts, length):
    """{id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = defaultdict(int)
    for b in data.values():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = {}
    for key, b in data.items():
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        out[key] = (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
