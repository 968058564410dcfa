"""Plain versions of the operators' results, one text or one small table at a time."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """docs: (doc_id, text), items: (item_id, text); rows doc_id, n_words, n_hit, n_items, sha, contaminated."""
    by_window = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            by_window.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in by_window}
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (held := by_window.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= held
        rows.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return rows


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    """(start, order of kind, end) of the base kinds, sorted."""
    return sorted((m.start(), i, m.end()) for i, (_, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text or "") if ok(m[0]))


def written(spans):
    return ",".join(f"{BASE[i][0]}:{s}:{e}" for s, i, e in spans)


PHRASES = ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl"))


def license_base(text):
    """Number of words, of places, first and last word, labels."""
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """docs: (doc_id, text) with distinct ids; doc_id: (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    held = {}
    for d, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(d)
    shared = {}
    for ids in held.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), k in shared.items() if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k)]
    label = components(sets, links)
    return {d: (len(sets[d]), label[d]) for d in sets}


def repeats(docs, width=200):
    """docs: (doc_id, text); rows doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            seen[w] = seen.get(w, 0) + 1
    rows = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        rows.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def lm_differences(docs, good, size=65_536, least=2, smoothing=0.5):
    """docs: (doc_id, text), good: ids; doc_id: (n_tokens, mean of target loss less background loss)."""
    import math
    from collections import Counter

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for d, t in docs}
    every = Counter(w for ws in split.values() for w in ws)
    known = {w for w, c in sorted(every.items(), key=lambda x: -x[1])[:size] if c > 1}
    coded = {d: [w if w in known else "" for w in ws] for d, ws in split.items()}
    counts = []
    for part in (list(coded), [d for d in coded if d in good]):
        one = Counter({w: 0 for w in known | {""}})
        two = Counter()
        for d in part:
            one.update(coded[d])
            two.update(zip(coded[d], coded[d][1:], strict=False))
        counts.append((one, two, sum(one.values())))
    (b1, b2, bn), (t1, t2, tn) = counts
    uni = lambda c, n, w: math.log((c[w] + smoothing) / (n + smoothing * (len(known) + 1)))
    rows = {}
    for d, ws in coded.items():
        total = 0.0
        for i, w in enumerate(ws):
            pair = (ws[i - 1], w)
            if i and b2[pair] >= least and t2[pair] >= least:
                total += math.log(b2[pair] / b1[pair[0]]) - math.log(t2[pair] / t1[pair[0]])
            else:
                total += uni(b1, bn, w) - uni(t1, tn, w)
        rows[d] = (len(ws), total / len(ws) if ws else None)
    return rows
