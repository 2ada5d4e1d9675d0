"""Plain Python versions of the operators, written from their definitions."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def removed(rows, window):
    """doc_id, n_words, n_removed, sha of each row (ids without nulls)."""
    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def simhash(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """Smallest id reachable for each (id, fingerprint)."""
    least = {}
    for doc, fp in prints:
        least[fp] = min(doc, least.get(fp, doc))
    parent = {fp: fp for fp in least}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                parent[root(a)] = root(b)
    group = collections.defaultdict(list)
    for fp, doc in least.items():
        group[root(fp)].append(doc)
    return {(doc, fp): min(group[root(fp)]) for doc, fp in prints}


def kneser_ney(train, order=2):
    """Log10 probability of a text under a bigram model of the training texts."""
    from rollmark.llm.ngram import discounts

    def tokens(text):
        return words((text or "").translate(LOWER)) + ["</s>"]

    grams = collections.Counter(p for t in train for p in zip(["<s>", *tokens(t)], tokens(t), strict=False))
    ends = collections.Counter(b for _, b in grams)
    context, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), n in grams.items():
        context[a] += n
        kinds[a][min(n, 3) - 1] += 1

    def off(counts):
        return discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])

    two, one = off(grams.values()), off(ends.values())
    total = sum(ends.values())
    rest = sum(one[min(n, 3)] for n in ends.values()) / total if total else 1.0

    def unigram(w):
        return (ends[w] - one[min(ends[w], 3)]) / total + rest / (len(ends) + 1) if total else 1 / (len(ends) + 1)

    def chance(a, w):
        if not context[a]:
            return unigram(w)
        back = sum(two[i + 1] * kinds[a][i] for i in range(3)) / context[a]
        return (grams[a, w] - two[min(grams[a, w], 3)]) / context[a] + back * unigram(w)

    def score(text):
        t = tokens(text)
        return sum(math.log10(chance(a, w)) for a, w in zip(["<s>", *t], t, strict=False))

    return score


def matches(docs, items, threshold=0.8, shingle=5):
    """(doc, item) -> best similarity and its first word."""
    listed = {i: alnum(t) for i, t in items}
    listed = {i: w for i, w in listed.items() if w}

    def shingles(w, k):
        return [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]

    of = {i: (min(shingle, len(w)), collections.Counter(shingles(w, min(shingle, len(w))))) for i, w in listed.items()}
    df = collections.Counter(s for _, c in of.values() for s in c)

    def weight(s):
        return round(1000 * math.log1p(len(of) / df.get(s, 1)))

    out = {}
    for doc, text in docs:
        w = alnum(text)
        for i, (k, counts) in of.items():
            own = shingles(w, k)
            size = min(sum(counts.values()), len(own))
            for at in range(len(own) - size + 1) if size else ():
                window = collections.Counter(own[at : at + size])
                shared = sum(min(n, counts[s]) * weight(s) for s, n in window.items())
                total = sum(n * weight(s) for s, n in window.items()) + sum(n * weight(s) for s, n in counts.items()) - shared
                if shared / total >= threshold and shared / total > out.get((doc, i), (0, 0))[0]:
                    out[doc, i] = (shared / total, at)
    return out


def crc(value):
    return zlib.crc32(str(value).encode())


def noisy(rows, noise=199, least=6):
    """Occurrences of the words of ``spelling_variants``."""
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=5):
    """Rows (word, form, root, n, n_near, form_n), every pair of words compared."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            if filled + s > middle:
                used, filled = used + 1, 0
            filled += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def shards_of(groups, shards):
    """Digest -> shard for (digest, size) in order, written from the rules."""
    rest, left, alone = list(groups), shards, []
    while rest:
        large = [g for g in rest if g[1] * left >= sum(s for _, s in rest)]
        if not large:
            break
        alone.append(min(large, key=lambda g: (-g[1], g[0])))
        rest.remove(alone[-1])
        left -= 1
    out = {d: i for i, (d, _) in enumerate(alone)}
    if not rest:
        return out
    capacity, edges = smallest_capacity([s for _, s in rest], left), [0]
    for _, s in rest:
        edges.append(edges[-1] + s)
    least = [edges[-1]] * (left + 1)
    for k in range(left - 1, -1, -1):
        least[k] = min(e for e in edges if e >= least[k + 1] - capacity)
    cuts, at = [], 0
    for k in range(1, left):
        even = at + (edges[-1] - at) // (left - k + 1)
        at = min((e for e in edges if max(least[k], at) <= e <= at + capacity), key=lambda e: (abs(e - even), e))
        cuts.append(at)
    return out | {d: len(alone) + sum(edges[i] >= c for c in cuts) for i, (d, _) in enumerate(rest)}


def phrases(rows, threshold=10, top=2000, absorbed=50):
    """Rows (lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


def thue_morse(bits):
    """A word of 2 ** bits letters and its complement, on which polynomials modulo powers of two meet."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate({97: 98, 98: 97})
