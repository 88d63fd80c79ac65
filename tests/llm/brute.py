"""Plain versions of the operators, for tests."""

import hashlib
import math
import re
from collections import Counter, defaultdict

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().translate(FOLD).split()


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_components(docs, n=2, similarity=80):
    """docs: (doc_id, text). The smallest reachable id of each."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            both = len(s & t)
            if both and 100 * both >= similarity * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def covered(docs, length=100):
    """docs: (doc_id, text) with distinct ids. For each id: bytes, removed, spans, digest of what is left."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            piece = data[at : at + length]
            if piece in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text, entropy=True):
    """The spans as (start, kind number, end); entropy ones as kind 3."""
    t = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    from rasterloom.llm.secrets import ALLOWED, CANDIDATE, CLASSES, WINDOW

    added = []
    for m in re.finditer(CANDIDATE, t):
        s = m[0]
        if re.search(ALLOWED, s) or any(a <= m.start() and b >= m.end() for a, _, b in base):
            continue
        least = next(bits for pattern, bits in CLASSES if re.search(pattern, s))
        hot = [k for k in range(len(s) - WINDOW + 1) if -sum(n / WINDOW * math.log2(n / WINDOW) for n in Counter(s[k : k + WINDOW]).values()) >= least - 1e-9]
        if hot:
            added.append((m.start() + hot[0], 3, m.start() + hot[-1] + WINDOW))
    return sorted(base), sorted(base + added)


def base_scores(docs, learns):
    """docs: (doc_id, text); learns: id -> bool. For each id: tokens, known tokens, base score; and N."""
    counts = Counter()
    for i, t in docs:
        if learns(i):
            counts.update(words(t))
            counts[None] += 1
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, t in docs:
        w = [*words(t), None]
        out[i] = (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w))
    return out, total


def trigram_scores(docs, learns, mu2, mu3):
    """docs: (doc_id, text); learns: id -> bool. The log10 probability of each text, from plain counts."""
    one, two, three, context = Counter(), Counter(), Counter(), Counter()

    def padded(t):
        return ["<s>", "<s>", *[("w", x) for x in words(t)], "</s>"]

    for i, t in docs:
        if learns(i):
            p = padded(t)
            context["<s>", "<s>"] += 1
            for u, v, w in zip(p, p[1:], p[2:]):
                one[w] += 1
                two[v, w] += 1
                three[u, v, w] += 1
    context.update(two)
    heads = Counter({"<s>": context["<s>", "<s>"]}) + Counter({w: c for w, c in one.items()})
    total, kinds = sum(one.values()), len(one)
    out = []
    for _, t in docs:
        p, score = padded(t), 0.0
        for u, v, w in zip(p, p[1:], p[2:]):
            p1 = (one[w] + 1) / (total + kinds + 1)
            p2 = (two[v, w] + mu2 * p1) / (heads[v] + mu2)
            score += math.log10((three[u, v, w] + mu3 * p2) / (context[u, v] + mu3))
        out.append((len(p) - 2, score))
    return out


def top_k(vectors, k=20, every=20):
    rows = {i: [math.floor(64 * x) for x in v] for i, v in vectors}
    out = defaultdict(list)
    for q, a in rows.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out
