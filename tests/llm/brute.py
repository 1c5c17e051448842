"""Plain versions of the operators' contracts, over lists of rows."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall(text or "")


def mix_targets(sizes: dict, weights=(5, 2, 1), most=3):
    """target by source; water-filling step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def near(docs):
    """component by doc_id, linking all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    owners = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    both = collections.Counter((a, b) for ds in owners.values() for a in ds for b in ds if a < b)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def removals(docs, window=13):
    """doc_id -> (n_words, n_removed, sha256)."""
    first, w = {}, {d: words(t) for d, t in docs}
    for d in sorted(w):
        for i in range(len(w[d]) - window + 1):
            first.setdefault(tuple(w[d][i : i + window]), d)
    out = {}
    for d, x in w.items():
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if first[tuple(x[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [y for y, g in zip(x, gone) if not g]
        out[d] = (len(x), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def language_model(docs, discount=0.75, least=2):
    """doc_id -> (held_out, n_tokens, n_known, N, base, score)."""
    tokens = {d: words((t or "").translate(LOWER)) + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for d, w in tokens.items():
        if not held[d]:
            c1.update(w), c2.update(zip(w, w[1:])), c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c1.values()), len(c1)
    c2, c3 = ({k: c for k, c in x.items() if c >= least} for x in (c2, c3))
    k1, k2 = collections.Counter(), collections.Counter()
    for k, c in c2.items():
        k1[k[0]] += c - discount
    for k, c in c3.items():
        k2[k[:2]] += c - discount

    def p(w, i):
        x = (c1[w[i]] + 1) / (n + v + 1)
        if i and c1[w[i - 1]]:
            x = max(c2.get((w[i - 1], w[i]), 0) - discount, 0) / c1[w[i - 1]] + (1 - k1[w[i - 1]] / c1[w[i - 1]]) * x
            pair = (w[i - 2], w[i - 1]) if i > 1 else ()
            if pair in c2:
                x = max(c3.get((*pair, w[i]), 0) - discount, 0) / c2[pair] + (1 - k2[pair] / c2[pair]) * x
        return x

    return {d: (held[d], len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(w, i)) for i in range(len(w)))) for d, w in tokens.items()}


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return len(gaps)


def order_minhash_samples(text, k=3):
    """The occurrence-numbered k-mers of a text, in order."""
    w = words(text)
    kmers = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)
    seen, out = collections.Counter(), []
    for x in kmers:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def order_minhash(text, bins=64, dealt=384, rounds=32):
    """sample -> tuple, by the definition: two least (round, hash) of each sample, in text order."""
    chain = lambda parts: functools.reduce(lambda seed, b: xxhash.xxh64_intdigest(b, seed), parts, 42)
    kmers = order_minhash_samples(text)
    held = collections.defaultdict(list)
    for r in range(min(rounds, math.ceil(dealt / len(kmers))) if kmers else 0):
        for at, (kmer, n) in enumerate(kmers):
            k = chain([w.encode() for w in kmer])
            k = (k - (1 << 64) if k >> 63 else k) >> 28
            h = chain([struct.pack("<q", k), struct.pack("<i", n), struct.pack("<i", r)])
            held[h >> 58].append((r, (h >> 28) % (1 << 30) >> 5, at))
    return {b: tuple(x[:2] for x in sorted(sorted(xs)[:2], key=lambda x: (x[2], x[:2]))) for b, xs in held.items()}


def order_minhash_likeness(a, b):
    a, b = order_minhash(a), order_minhash(b)
    either = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 1.0


def license_hits(text, templates, threshold=0.8, exact=64, seed=4):
    """(name, dice, first word, words) of every hit, every window tried; templates are (name, text)."""
    verbs = ("released", "distributed", "published", "available")

    def spelt(t):
        t = re.sub(r"licence", "license", (t or "").lower())
        for v in verbs:
            t = re.sub(v + r"([\W_]+under)", r"licensed\1", t)
        w = re.findall(r"[^\W_]+", t)
        return list(zip(w, w[1:]))

    b, found = spelt(text), []
    for k, (name, t) in enumerate(templates):
        of = spelt(t)
        own, n, best = set(of), len(set(of)), None
        for i in range(len(b)):
            run = 1 if n <= exact else seed
            if any(x not in own for x in b[i : i + run]) or len(b[i : i + run]) < run or (n > exact and i and b[i - 1] in own):
                continue
            seen, common = set(), 0
            for j in range(i, min(len(b), i + 2 * len(of))):
                if b[j] not in seen:
                    seen.add(b[j])
                    common += b[j] in own
                w = len(seen)
                dice = 2 * common / (w + n)
                # The same bounds as whole numbers: 2 * smaller >= threshold * (smaller + larger).
                if 2 * min(w, n) >= threshold * (w + n) - 1e-9 and dice >= threshold and (best is None or dice > best[0]):
                    best = (dice, i, j - i + 2)
        if best:
            found.append((best[0], n, -k, name, best[1], best[2]))
    shared = lambda g, h: min(g[4] + g[5], h[4] + h[5]) - max(g[4], h[4])
    kept = [h for h in found if not any(g[:3] > h[:3] and 2 * shared(g, h) >= h[5] for g in found)]
    return [(name, dice, i, w) for dice, _, _, name, i, w in sorted(kept, key=lambda h: (h[4], -h[2]))]


def audio_features(payload, rate=16000, up=5, down=8, taps=16, size=256, hop=128, bands=16, slots=8):
    """Pooled log-mel by sums: every sample, frame and filter in turn. Returns it and its eighths."""
    x = [(b - 128) / 128 for b in payload]
    n_taps = up * taps
    t = np.arange(n_taps) - (n_taps - 1) / 2
    h = np.sinc(t / down) * np.hanning(n_taps + 2)[1:-1]
    y = []
    for n in range(-(-len(x) * up // down)):
        at, phase = divmod(n * down, up)
        own = h[phase::up] / h[phase::up].sum()
        y.append(sum(own[k] * x[at - k] for k in range(taps) if 0 <= at - k < len(x)))
    frames = max(1, -(-(len(y) - size) // hop) + 1)
    y = np.array(y + [0.0] * ((frames - 1) * hop + size - len(y)))
    new = rate * up / down
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(40) + (mel(new / 2) - mel(40)) * i / (bands + 1)) / 2595) - 1) for i in range(bands + 2)]
    basis = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    rows = []
    for i in range(frames):
        power = np.abs(basis @ (y[i * hop : i * hop + size] * np.hanning(size))) ** 2
        row = []
        for b in range(bands):
            low, mid, high = edges[b : b + 3]
            total = 0.0
            for k, p in enumerate(power):
                f = k * new / size
                total += p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))
            row.append(math.log(total + 1e-6))
        rows.append(row)
    cut = [frames * i / slots for i in range(slots + 1)]
    pooled = np.array([np.mean(rows[int(a) : max(math.ceil(b), int(a) + 1)], axis=0) for a, b in zip(cut, cut[1:])])
    return pooled, np.round(pooled.ravel() * 8).astype(int)


def additive_model(x, y, bins, pair_bins, pairs, rounds, pair_rounds, rate, ridge):
    """Cyclic boosting by trying every tree on every row. Returns the scores of rows."""
    n = len(x[0])
    cuts = lambda f, b: sorted({float(np.float32(v)) for v in np.quantile([r[f] for r in x], np.arange(1, b) / b)})
    edges, coarse = [cuts(f, bins) for f in range(n)], [cuts(f, pair_bins) for f in range(n)]
    bin_of = lambda v, e: sum(v >= c for c in e)
    p = (sum(y) + 1) / (len(y) + 2)
    start = math.log(p / (1 - p))
    total, steps = [start] * len(x), []

    def gradient():
        q = [1 / (1 + math.exp(-t)) for t in total]
        return [b - a for a, b in zip(q, y)], [a * (1 - a) for a in q]

    value = lambda rows, g, h: sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
    gain = lambda rows, g, h: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + ridge)

    def best_cut(rows, key, lo, hi, g, h, least=1e-12):
        """The bin in (lo, hi) at which a split of the rows gains most, or None."""
        tried = [(gain([i for i in rows if key(i) < c], g, h) + gain([i for i in rows if key(i) >= c], g, h) - gain(rows, g, h), -c) for c in range(lo + 1, hi)]
        top = max(tried, default=(0, 0))
        return -top[1] if top[0] > least else None

    def apply(leaves):
        """leaves: (test of a row of bins, step)."""
        steps.append(leaves)
        for i, r in enumerate(x):
            total[i] += next(s for test, s in leaves if test(r))

    for _ in range(rounds):
        for f in range(n):
            g, h = gradient()
            e, rows = edges[f], list(range(len(x)))
            key = lambda i, f=f, e=e: bin_of(x[i][f], e)
            size = len(e) + 1
            middle = best_cut(rows, key, 0, size, g, h)
            marks = [0, size]
            if middle is not None:
                marks.append(middle)
                for lo, hi in ((0, middle), (middle, size)):
                    at = best_cut([i for i in rows if lo <= key(i) < hi], key, lo, hi, g, h)
                    marks += [at] if at is not None else []
            marks.sort()
            apply([(lambda r, f=f, e=e, lo=lo, hi=hi: lo <= bin_of(r[f], e) < hi, rate * value([i for i in rows if lo <= key(i) < hi], g, h)) for lo, hi in zip(marks, marks[1:])])

    def pair_tree(a, b, g, h):
        rows, best = range(len(x)), None
        for first, second in ((a, b), (b, a)):
            k1 = lambda i, f=first: bin_of(x[i][f], coarse[f])
            k2 = lambda i, f=second: bin_of(x[i][f], coarse[f])
            for at in range(1, len(coarse[first]) + 1):
                leaves, sum_of = [], 0.0
                for lo, hi in ((0, at), (at, len(coarse[first]) + 1)):
                    side = [i for i in rows if lo <= k1(i) < hi]
                    cut = best_cut(side, k2, 0, len(coarse[second]) + 1, g, h, -math.inf) or 0
                    for c, d in ((0, cut), (cut, len(coarse[second]) + 1)):
                        own = [i for i in side if c <= k2(i) < d]
                        sum_of += gain(own, g, h)
                        leaves.append((lambda r, f=first, s=second, lo=lo, hi=hi, c=c, d=d: lo <= bin_of(r[f], coarse[f]) < hi and c <= bin_of(r[s], coarse[s]) < d, rate * value(own, g, h)))
                if best is None or sum_of > best[0] + 1e-12:
                    best = (sum_of, leaves)
        return best[0] - gain(rows, g, h), best[1]

    every = [(a, b) for a in range(n) for b in range(a + 1, n)]
    g, h = gradient()
    gains = {p: pair_tree(*p, g, h)[0] for p in every}
    chosen = sorted(every, key=gains.get, reverse=True)[:pairs]
    for _ in range(pair_rounds):
        for p in chosen:
            apply(pair_tree(*p, *gradient())[1])
    return chosen, lambda r: 1 / (1 + math.exp(-(start + sum(next(s for test, s in leaves if test(r)) for leaves in steps))))
