"""Plain versions of the operators' contracts, row by row, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)


def spaces(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rest(doc_id, modulus=5):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def contamination(text, items, size=10):
    words = plain_words(text)
    windows = defaultdict(set)
    for item_id, item in items:
        own = plain_words(item)
        n = min(size, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            windows[tuple(own[s : s + n])].add(str(item_id))
    hit, found = set(), set()
    for n in {len(w) for w in windows}:
        for at in range(len(words) - n + 1):
            if own := windows.get(tuple(words[at : at + n])):
                hit.update(range(at, at + n))
                found |= own
    return len(words), len(hit), sorted(found)


def shingle_set(text, size=5):
    words = spaces(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(rows, percent=75, size=5):
    """[(doc_id, n_shingles, component_id)] in the order of rows (doc_id, text)."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    post = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            post[g].append(i)
    pairs = {(a, b) for own in post.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [(doc_id, len(sets[i]), min(least[root(i)], default=None)) for i, (doc_id, _) in enumerate(rows)]


def base_scores(rows, folds=5, held=1):
    """{row index: (n_tokens, n_known, N, base)}"""
    counts = Counter()
    for doc_id, text in rows:
        if rest(doc_id, folds) != held:
            counts.update(spaces(text))
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        tokens = [*spaces(text), "\n"]
        out.append((len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    return out


def suffix_scores(rows, divergence, weights, share):
    """log10 probability of each row by the suffix tree over words, place by place."""
    learn = [(["<", "<", *spaces(t), "\n"]) for i, t in rows if rest(i) != 1]
    everything = Counter(w for _, t in rows for w in [*spaces(t), "\n"])
    counts = Counter(w for own in learn for w in own[2:])
    n, v, total = sum(counts.values()), len(counts), sum(everything.values())
    p0 = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    most = (share * total + 0.5) / (n + 0.5 * (v + 1))
    test0 = lambda w: p0(w) if everything[w] >= share * total or w == "\n" else most
    follows = [defaultdict(Counter), defaultdict(Counter)]
    for own in learn:
        for k in range(2, len(own)):
            follows[0][own[k - 1]][own[k]] += 1
            follows[1][own[k - 2], own[k - 1]][own[k]] += 1
    weight = [{}, {}]

    def p(w, before, nearest, root, depth):
        out = root(w)
        for level, context in list(enumerate((nearest, (before, nearest))))[:depth]:
            if context in weight[level]:
                own = follows[level][context]
                out = (own[w] + weight[level][context] * out) / (sum(own.values()) + weight[level][context])
        return out

    for level in range(2):
        for context, own in follows[level].items():
            before, nearest = context if level else (None, context)
            many = sum(own.values())
            parent = {w: p(w, before, nearest, test0, level) for w in own}
            gains = {x: sum(c * math.log((c - 1 + x * parent[w]) / ((many - 1 + x) * parent[w])) for w, c in own.items()) for x in weights}
            best = max(weights, key=gains.get)
            if gains[best] >= divergence:
                weight[level][context] = best
    out = []
    for _, t in rows:
        own = ["<", "<", *spaces(t), "\n"]
        out.append(sum(math.log10(p(own[k], own[k - 2], own[k - 1], p0, 2)) for k in range(2, len(own))))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target} by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in order}
        full |= over
