"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality_base(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def quality(rows, min_docs=5, max_docs=20, share=0.1):
    """rows: (doc_id, text, host), distinct ids -> a row each: the base counts and verdict, and whether it is kept."""
    docs, holders = Counter(h for _, _, h in rows), defaultdict(set)
    norm = lambda line: tuple(words(line.lower()))
    for d, t, h in rows:
        for line in (t or "").split("\n"):
            if words(line):
                holders[h, norm(line)].add(d)
    frequent = {at for at, ids in holders.items() if len(ids) > max_docs or len(ids) > max(min_docs, share * docs[at[0]])}
    out = []
    for d, t, h in rows:
        base = quality_base(t)
        cut = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and (h, norm(x)) in frequent and d != min(holders[h, norm(x)]))
        left = base[0] - cut
        out.append((*base, not base[5] and left >= 10 and left >= 0.5 * base[0]))
    return out


def substring_dedup(rows, n=20):
    """rows: (doc_id, text) with distinct ids, in id order -> {doc_id: (n_words, n_removed, digest)}."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                gone[i : i + n] = [True] * n
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets_base(text):
    text, spans = text or "", []
    spans += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    n = Counter(x[2] for x in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


def token_rows(rows, tokenizer):
    """rows: (doc_id, text) with distinct ids -> [(doc_id, start, n, crc)]."""
    at, out = 0, []
    for d, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def targets(sizes, total=1.5, weights=(5, 2, 1), most=2):
    """sizes: {source: words} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, fixed = total * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def shingles(text, n=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def near_duplicates(rows, least=0.8):
    """rows: (doc_id, text), distinct ids -> {doc_id: (class id, links)}; links between different documents."""
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links, ids = Counter(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= least * len(x | y):
                links[a] += 1
                links[b] += 1
                r, s = sorted((find(a), find(b)))
                top[s] = r
    return {d: (find(d), links[d]) for d in ids}


def overlaps(docs, items, window=13, share=0.8, shortest=8):
    """docs, items: (id, text) -> {(doc position, item position): (first word, end word, covered words, item words)}."""
    mark = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    clean = lambda t: [x for x in (w.strip(mark) for w in words((t or "").lower())) if x]
    out, texts = {}, [clean(t) for _, t in items]
    for p, (_, t) in enumerate(docs):
        d = clean(t)
        for q, x in enumerate(texts):
            n, good = min(window, len(x)), []
            need = len(x) if len(x) < shortest else -(-n * round(share * 100) // 100)
            for s in range(len(x) - n + 1 if x else 0):
                good += [(i, s) for i in range(len(d) - n + 1) if sum(d[i + k] == x[s + k] for k in range(n)) >= need]
            if good:
                out[p, q] = (min(i for i, _ in good), max(i for i, _ in good) + n, len({s + k for _, s in good for k in range(n)}), len(x))
    return out
