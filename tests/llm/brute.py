"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def grams(text, width):
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def groups(docs, width, percent):
    """{id: (size, smallest id reachable)} by comparing all pairs that share an n-gram."""
    sets = {i: grams(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = {}
    for i in sorted(sets):
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    for a, b in {(v[x], v[y]) for v in holders.values() for x in range(len(v)) for y in range(x)}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    """Counts of the base kinds and the digest of their spans."""
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)).encode()).hexdigest()
    return [sum(o[3] == k for o in out) for k in ("assign", "access", "hex")] + [digest]


def licences(docs, templates, least):
    """{id: (licence, score, whole)} of the best part: the text, a line, or a sentence of one."""
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    held = Counter(t for _, text in docs for t in set(cut(text or "")))
    weight = lambda t: math.log((1 + len(docs)) / (1 + held[t])) + 1
    vector = lambda x: {t: c * weight(t) for t, c in Counter(cut(x)).items()}
    size = lambda v: math.sqrt(sum(z * z for z in v.values()))
    rows = [(name, vector(x), opens) for name, x, opens in templates]
    out = {}
    for i, text in docs:
        if i is None:
            continue
        found, whole = [], False
        lines = (text or "").split("\n")
        for part, line in enumerate([text or "", *lines, *(x for line in lines for x in re.split(r"[.;!?][ \t]+", line))]):
            v = vector(line)
            for name, w, opens in rows if v else []:
                score = round(sum(v[x] * w[x] for x in w if x in v) / size(v) / size(w), 6)
                if score >= least:
                    found.append((-score, name, part))
                    whole |= part == 0 or opens
        if found:
            out[i] = (min(found)[1], -min(found)[0], whole)
    return out


def nearest(rows, is_query, k, shown=int):
    """[(query, rank, id, score)] over (id, whole-number vector); `shown` is applied to a score before it counts."""
    out, seen = [], set()
    for i, q in rows:
        if is_query(i) and i not in seen:
            seen.add(i)
            best = sorted((-shown(sum(a * b for a, b in zip(q, x))), j) for j, x in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def holds(text, item, width=5, percent=80):
    """Whether a text has enough of an item's windows word by word; for texts without numbers and names."""
    cut = lambda t: re.findall(r"[^\W\d_]+", lowered(t))
    own = {tuple(w[k : k + width]) for w in [cut(item)] for k in range(len(w) - width + 1)}
    there = {tuple(w[k : k + width]) for w in [cut(text)] for k in range(len(w) - width + 1)}
    return bool(own) and 100 * len(own & there) >= percent * len(own)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    """[(item, rank, id, score, matched)] by scoring every document for every item."""
    named = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs if i is not None]
    full = [(i, c) for i, c in named if c]
    total, n_docs = sum(sum(c.values()) for _, c in full), len(full)
    held = Counter(t for _, c in full for t in c)
    wanted, out = {}, []
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall(lowered(t)))
    for item, terms in wanted.items():
        rows = []
        for i, c in full:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms & set(c))
            if score > 0:
                rows.append((-score, i, -len(terms & set(c))))
        out += [(item, rank + 1, i, -s, -m) for rank, (s, i, m) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def _clamped(n):
    return min(max(n, -(2**63)), 2**63 - 1)


def mined(rows, is_anchor, n_positives, n_negatives):
    """[(anchor, positive, rank, negative, positive score, negative score)] over whole-number vectors (id, label, values)."""
    anchors, out = {}, []
    for i, label, v in rows:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        scored = [(-_clamped(sum(x * y for x, y in zip(v, w))), i, other) for i, other, w in rows if i != a]
        positives = sorted((s, i) for s, i, other in scored if other == label)[:n_positives]
        for s, p in positives:
            negatives = sorted((t, i) for t, i, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:n_negatives]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i) in enumerate(negatives)]
    return sorted(out)
