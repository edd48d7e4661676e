"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, pairs):
    """Smallest member of each node's class."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def substrings(docs, length=100):
    """{id: (kept bytes, bytes removed, runs)} of unique ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            part = data[p:p + length]
            if part in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (kept, sum(gone), runs)
    return out


def vectors(rows, threshold=0.93):
    """{id: (links, class)} of (id, label, vector)."""
    good = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, float))
    pairs = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0]
             and len(good[a][1]) == len(good[b][1])
             and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= threshold]
    links = Counter(x for p in pairs for x in p)
    named = classes([r[0] for r in rows], pairs)
    return {i: (links[i], named[i]) for i in named}


def simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_documents(docs, distance=3):
    """{id: (fingerprint, class)} of unique ids."""
    prints = {i: simhash(t) for i, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= distance]
    named = classes(ids, pairs)
    return {i: (prints[i], named[i]) for i in ids}


def lines(docs):
    """{id: (lines with a word, removed, text left)} of unique ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        every = (text or "").split("\n")
        real = [i for i, x in enumerate(every) if WORD.search(x)]
        gone = set()
        for k in range(len(real) - 2):
            window = tuple(every[i] for i in real[k:k + 3])
            if window in seen:
                gone.update(real[k:k + 3])
            seen.add(window)
        out[doc] = (len(real), len(gone), "\n".join(x for i, x in enumerate(every) if i not in gone))
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    real = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(real) - len(set(real)), len(covered))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def runs(words, copies=4, least=6):
    """(start, length, period) of the runs, in order: every period is tried at every place."""
    found, n = {}, len(words)
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, copies * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((x, y - x, q) for (x, y), q in found.items())
