"""Brute-force versions of the operators, written independently of them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def mix_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in rest}
        fixed |= {s: 3.0 * sizes[s] for s in above}


def shingle_set(text, width=3):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)])


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, width=3, percent=90):
    sets = {i: shingle_set(t, width) for i, t in docs}
    ids, links = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, components(ids, links), links


def quality(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def secret_base(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    names = ("assign", "access", "hex")
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def cosine_links(vectors, threshold=0.95):
    good = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = sorted(good)
    unit = {i: good[i] / np.linalg.norm(good[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, links
