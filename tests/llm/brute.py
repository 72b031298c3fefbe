"""Plain versions of the operators, for small inputs."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def groups(n, links):
    """Smallest index reachable from each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lines(docs):
    """{id: (lines, dropped, kept text)} of (id, text) with unique ids."""
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                holders[key(x)].add(d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if d is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out[d] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _spans(text, rules):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(rules)
                   for m in re.finditer(rx, text) if ok(m))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return _spans(text or "", [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)])


def secrets(text):
    return _spans(text or "", [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)])


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def near_documents(texts, width):
    """(set size, group) of each text."""
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], groups(len(sets), links)


def near_vectors(vectors, threshold=0.95):
    """(links, group) of each vector."""
    units = []
    for v in vectors:
        x = None if v is None or None in v else np.array(v, float)
        ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
        x = x / np.abs(x).max() if ok else None  # else the square of a large component overflows
        units.append(x / np.linalg.norm(x) if ok else None)
    links = [(i, j) for j in range(len(units)) for i in range(j) if units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    return [sum(i in p for p in links) for i in range(len(units))], groups(len(units), links)


def repeats(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        starts = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), starts, bytes(c for c, g in zip(b, gone) if not g)))
    return out
