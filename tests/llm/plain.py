"""Brute-force versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def contamination(docs, items, width=10):
    """{position: (words, hit words, items, digest, flag)} for (id, text) rows."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for _, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit)))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, ids, bits=3):
    """Smallest id of each one's group; nulls only where there is no other."""
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    codes = np.array(fingerprints, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= bits).tolist():
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    members = {}
    for k, i in enumerate(ids):
        members.setdefault(top(k), []).append(i)
    smallest = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return [smallest[top(k)] for k in range(len(ids))]


def in_a_language(rows):
    """The (id, text, lang) rows close enough to a language, with trigrams bundled one by one."""
    from gridverify.llm import language

    vectors, cached = language.Vectors(language.DIMENSIONS), {}

    def trigrams(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = f" {' '.join(letters.split())} "
        return [padded[i : i + 3] for i in range(len(padded) - 2)] if padded.strip() else []

    def vector(gram):
        if gram not in cached:
            a, b, c = (vectors.letter(ord(x)).astype(float) for x in gram)
            cached[gram] = np.roll(a, 2) * np.roll(b, 1) * c
        return cached[gram]

    bundles = [sum((vector(g) for g in trigrams(t)), np.zeros(language.DIMENSIONS)) for _, t, _ in rows]
    sizes = [len(trigrams(t)) for _, t, _ in rows]
    names = sorted({l for (_, _, l), n in zip(rows, sizes) if l is not None and n})
    whole = np.array([sum(b for (_, _, l), b in zip(rows, bundles) if l == name) for name in names])
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    cosine = [whole @ b / max(np.linalg.norm(b), 1e-9) if n else np.zeros(len(names)) for b, n in zip(bundles, sizes)]
    length = [n.bit_length() - 1 for n in sizes]
    by_length = {}
    for (_, _, l), c, n, k in zip(rows, cosine, sizes, length):
        if n and names[int(c.argmax())] == l:
            by_length.setdefault(k, []).append(float(c.max()))
    limit = {}
    for k, found in by_length.items():
        if len(found) >= language.FEW:
            limit[k] = max(language.NOISE, language.SHARE * sorted(found)[int(np.ceil(language.LOWEST * len(found))) - 1])
    return [r for r, c, n, k in zip(rows, cosine, sizes, length) if n and c.max() >= limit.get(k, language.NOISE)]

