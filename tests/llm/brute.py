"""Plain versions of the training-data operators, straight from their contracts."""

import re

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text):
    words = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=2):
    """{position: smallest id reachable} of (id, fingerprint) rows."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[root(f)] = min(d, low.get(root(f), d))
    return [low.get(root(f)) for _, f in rows]


def repeated(rows, n=50):
    """(id, bytes, removed, spans, kept) of (id, text) rows; a null id is larger than all others."""
    key = lambda i: (1 << 63) if i is None else i
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            w = b[j : j + n]
            low[w] = min(key(i), low.get(w, key(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if low[b[j : j + n]] < key(i):
                gone[j : j + n] = b"\1" * n
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def aligned(item, doc, window=15, allowed=3):
    """(place in doc, place in item, aligned, equal) of every stretch of windows with few enough differences."""
    if len(item) < window:
        window, allowed = len(item), len(item) // 5 if len(item) >= 8 else 0
    found = []
    for shift in range(-len(item), len(doc)) if item else ():
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(lo, hi)]
        inside = set()
        for k in range(len(same) - window + 1):
            if sum(same[k : k + window]) >= window - allowed:
                inside.update(range(k, k + window))
        for a in sorted(k for k in inside if k - 1 not in inside):
            e = next(k for k in range(a, len(same) + 1) if k not in inside)
            found.append((a + lo + shift, a + lo, e - a, sum(same[a:e])))
    return found
