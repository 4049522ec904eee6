"""Brute-force versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, num, den):
    """doc_id -> (set size, least doc_id reachable)."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, length=100):
    """doc_id -> (bytes, removed, spans, digest of what is left)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for q, g in enumerate(gone) if g and (q == 0 or not gone[q - 1]))
        out[i] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def generalised_jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    every = a.keys() | b.keys()
    return sum(min(a[w], b[w]) for w in every) / sum(max(a[w], b[w]) for w in every) if every else 1.0
