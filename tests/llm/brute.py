"""Plain-Python versions of the corpus operators for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter

BLANKS = " \t\n\x0b\f\r"


def words(text):
    return (text or "").encode().split()


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def folded(text):
    return bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32
                 for b in (text or "").encode()).split()


def windows_removed(rows, size=50):
    """doc_id -> (n_words, n_removed, sha256) for (doc_id, text) rows with distinct ids."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[j:j + size]), doc) < doc:
                gone[j:j + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, a):
        while self.p[a] != a:
            self.p[a] = self.p[self.p[a]]
            a = self.p[a]
        return a

    def join(self, a, b):
        self.p[self.find(a)] = self.find(b)


def near_classes(rows, threshold=0.8):
    """doc_id -> smallest doc_id of its class by weighted Jaccard of 5-word shingles."""
    bags = []
    for _, text in rows:
        w = lower(text)
        bags.append(Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5
                    else Counter([tuple(w)] if w else []))
    u = Union(len(rows))
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            common = sum((a & b).values())
            if common and common >= threshold * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
                u.join(i, j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(u.find(i), []).append(doc)
    return {d: min(x) for x in ids.values() for d in x}


def contained(rows, items, threshold=0.8):
    """(item_id, doc_id) -> containment of the item's shingles."""
    def grams(w):
        return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    out = {}
    for doc, text in rows:
        w = folded(text)
        for item, t in items:
            q = grams(folded(t))
            k = min(5, len(folded(t)))
            have = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            if q and len(q & have) / len(q) >= threshold:
                out[item, doc] = len(q & have) / len(q)
    return out


def lines_removed(rows, threshold=0.8):
    """doc_id -> line numbers that go, for rows with distinct ids."""
    occ, forms = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((text or "").split("\n")):
            f = line.strip(BLANKS).lower()
            if f:
                occ.append((doc, n, forms.setdefault(f, len(forms))))
    sets = [{f[j:j + 8] for j in range(max(1, len(f) - 7))} for f in forms]
    u = Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= threshold * (len(a) + len(sets[j]) - both) - 1e-9:
                u.join(i, j)
    out, seen = {}, set()
    for doc, n, f in occ:
        if u.find(f) in seen:
            out.setdefault(doc, []).append(n)
        seen.add(u.find(f))
    return out


def base_rules(text):
    x = text or ""
    w = words(x)
    at = {}
    for j in range(len(w) - 4):
        at.setdefault(tuple(w[j:j + 5]), []).append(j)
    cover = {k for v in at.values() if len(v) > 1 for j in v for k in range(j, j + 5)}
    lines = [y for y in x.split("\n") if y.encode().split()]
    return (len(w), sum(len(y.decode()) for y in w), sum(x.count(s) for s in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(cover))
