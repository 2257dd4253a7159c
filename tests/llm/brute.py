"""Plain versions of the corpus operators, over Python lists."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text, q):
    w = WHITE.findall(lower(text))
    return {tuple(w[i : i + q]) for i in range(len(w) - q + 1)} if len(w) >= q else {tuple(w)} if w else set()


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def ngram_join(docs, q, percent):
    sets = {d: shingle_set(t, q) for d, t in docs}
    by, links = defaultdict(list), []
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in by[x]:
                if e < d:
                    common[e] += 1
        links += [(e, d) for e, n in common.items() if 100 * n >= percent * (len(s) + len(sets[e]) - n)]
    r = roots(list(sets), links)
    return {d: (len(s), r[d]) for d, s in sets.items()}


def near_vectors(rows, least):
    ok = {i: np.array(v, dtype=float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    n, links = {i: 0 for i, _ in rows}, []
    ids = sorted(ok)
    for a in range(len(ids)):
        for b in range(a):
            x, y = ok[ids[a]], ok[ids[b]]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links.append((ids[a], ids[b]))
                n[ids[a]] += 1
                n[ids[b]] += 1
    r = roots([i for i, _ in rows], links)
    return {i: (n[i], r[i], r[i] == i) for i, _ in rows}


def contamination(docs, items, size=13):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            wins[tuple(w[k : k + size])].add(i)
    lengths, out = sorted({len(w) for w in wins}), {}
    for d, t in docs:
        w, hit, names = ALNUM.findall(lower(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    names |= {str(i) for i in wins[x]}
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, window=35):
    words = [(d, WHITE.findall(t or "")) for d, t in docs]
    seen = defaultdict(int)
    for _, w in words:
        for k in range(len(w) - window + 1):
            seen[hash(tuple(w[k : k + window]))] += 1
    out = {}
    for d, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[hash(tuple(w[k : k + window]))] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def token_ids(text, tokenizer):
    return [*(tokenizer.encode(text or "", add_special_tokens=False).ids), 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def source_targets(sizes, weights, most):
    """sizes: name -> words. Exact fractions; names in order, None last."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return out | share
        out |= {s: Fraction(most * sizes[s]) for s in above}
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def rebuilt(turns):
    """conv_id -> list of (role, text); turns: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = {c: c - int(np.fmod(c, 100)) for c in own}
    return {c: own.get(base[c], [])[: h[c]] + own[c][h[c] :] for c in own}


def trie(turns):
    convs = rebuilt(turns)
    nodes = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[tuple(convs[c][:d])].append(c)
    kids = defaultdict(set)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        sums[k] = (sum(sums[x][0] for x in kids[k]) or 1, own + sum(sums[x][1] for x in kids[k]))
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(k))
        out.append((members[0], len(k), nodes[k[:-1]][0] if k else None, len(members), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def collocations(docs, least=30, top=2000, share=80):
    """docs: (lang, text)."""
    n, f = defaultdict(int), defaultdict(int)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(len(w)):
                for m in range(1, 5):
                    if k + m <= len(w):
                        f[lang, w[k : k + m]] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for k in range(len(w) - m + 1):
                if 100 * a >= share * f[lang, w[k : k + m]]:
                    gone.add((lang, w[k : k + m]))
    rows = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows[lang].append((-score, -a, " ".join(w).encode(), " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p, -a, l, rr, n[lang], -s) for lang, x in rows.items() for r, (s, a, _, p, l, rr) in enumerate(sorted(x)[:top], 1))
