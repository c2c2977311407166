"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

A_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lowered(text):
    return (text or "").encode().translate(A_Z)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def fingerprint(text):
    words = lowered(text).split()
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, bits=3):
    fps = np.array(prints, np.uint64)
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= bits):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, doc_id in enumerate(ids):
        least[root(i)].append(doc_id)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(ids))]


def repeats_removed(texts, window=35):
    docs = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(
        tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1)
    )
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(texts, items, window=13):
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split.findall(lowered(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, found = split.findall(lowered(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if holders := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= holders
        names = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def trigram_scores(ids, texts, discount=0.75):
    """(n_tokens, n_known, train_tokens, base_score, score) per text."""
    docs = [lowered(t).split() for t in texts]
    counts, before = [collections.Counter() for _ in range(3)], collections.Counter()
    for doc_id, w in zip(ids, docs):
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10:
            tokens = [0, *w, None]
            for order in (1, 2, 3):
                grams = [tuple(tokens[i : i + order]) for i in range(order == 1, len(tokens) - order + 1)]
                counts[order - 1].update(grams)
                before.update(g[:-1] for g in grams)
    one, n, v = counts[0], sum(counts[0].values()), len(counts[0])
    following = collections.Counter(g[:-1] for c in counts[1:] for g in c)
    out = []
    for w in docs:
        tokens, base, score = [0, *w, None], 0.0, 0.0
        for i in range(1, len(tokens)):
            p = (one[tokens[i],] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for order in (2, 3) if i > 1 else (2,):
                gram = tuple(tokens[i - order + 1 : i + 1])
                if before[gram[:-1]]:
                    own = max(counts[order - 1][gram] - discount, 0) / before[gram[:-1]]
                    p = own + discount * following[gram[:-1]] / before[gram[:-1]] * p
            score += math.log10(p)
        out.append((len(tokens) - 1, sum(one[y,] > 0 for y in tokens[1:]), n, base, score))
    return out


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def merkle(nodes, arity=8):
    """The root, and for each node its (left, right) siblings level by level."""
    paths, level = [[] for _ in nodes], [(n, [i]) for i, n in enumerate(nodes)]
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for run in runs:
            for j, (_, below) in enumerate(run):
                siblings = "".join(n for n, _ in run[:j]), "".join(n for n, _ in run[j + 1 :])
                for k in below:
                    paths[k].append(siblings)
        level = [(sha(*[n for n, _ in run]), [k for _, b in run for k in b]) for run in runs]
    return level[0][0], paths


def manifest(rows):
    """(leaf, subroot, root, proof_sha256, folded_root) per row of (doc_id, source, lang, n_chars, text)."""
    trees = collections.defaultdict(list)
    for at, row in enumerate(rows):
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), at))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [merkle([t[2] for t in sorted(trees[lang])]) for lang in langs]
    root, tops = merkle([b[0] for b in built])
    out = [None] * len(rows)
    for lang, (subroot, paths), top in zip(langs, built, tops):
        for (_, _, own, at), path in zip(sorted(trees[lang]), paths):
            path, row = path + top, rows[at]
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf(*row[:4], None if row[4] is None else lowered(row[4]).decode())
            for left, right in path:
                node = sha(left, node, right)
            out[at] = (own, subroot, root, sha(*[x for step in path for x in step]), node)
    return out


def importance(rows, targets, buckets=10_000, percent=10, min_words=20, seed=2024):
    """(n_features, weight, score, rank) per (doc_id, text)."""
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hashed = lambda text: [zlib.crc32(w) % buckets for w in split.findall(lowered(text))]
    docs = [hashed(text) for _, text in rows]
    s, t = collections.Counter(b for d in docs for b in d), collections.Counter(b for x in targets for b in hashed(x))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, order = [], []
    for at, ((doc_id, _), d) in enumerate(zip(rows, docs)):
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in d]
        weight = sum(gain) // len(gain) if gain else 0
        name = "null" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([len(d), weight, score, None])
        if len(d) >= min_words:
            order.append((-score, doc_id is None, doc_id or 0, at))
    for rank, (*_, at) in enumerate(sorted(order)[: percent * len(order) // 100], 1):
        out[at][3] = rank
    return [tuple(x) for x in out]
