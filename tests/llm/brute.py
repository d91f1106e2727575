"""Plain Python versions of the operators that SQL can't express or that need small hostile inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, size):
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(docs, size, percent):
    """{id: (n, component)} of {id: text}."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def substring_dedup(docs, window):
    """{id: (n_words, n_removed, kept words)} of {id: text}."""
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, ws in words.items():
        gone = {q for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] < i for q in range(p, p + window)}
        out[i] = (len(ws), len(gone), [w for p, w in enumerate(ws) if p not in gone])
    return out


def contamination(docs, items, window):
    """{id: (n_words, n_hit, items, contaminated)}."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[p : p + window])].add(str(item))
    out = {}
    for i, t in docs.items():
        w, hit, found = cut(t), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if (key := tuple(w[p : p + size])) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[key]
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near_vectors(rows, cosine):
    """{id: (links, component)} of (id, vector, label)."""
    fine = {i: (v, lab) for i, v, lab in rows if v and lab is not None and all(x is not None and abs(x) < float("inf") for x in v) and any(v)}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, (v, _) in fine.items()}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= cosine]
    found = components([i for i, *_ in rows], links)
    return {i: (sum(i in pair for pair in links), found[i]) for i, *_ in rows}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill(budget, children):
    """Budget shared by weight under limits: {name: (weight, cap)} -> {name: share}, exact to a token each."""
    left, out, rest = dict(children), {}, budget
    while left:
        total = sum(w for w, _ in left.values())
        full = {n for n, (w, cap) in left.items() if total and cap * total <= rest * w}
        if not full:
            out |= {n: (rest * w // total if total else 0) for n, (w, _) in left.items()}
            break
        for n in full:
            out[n] = left.pop(n)[1]
        rest = budget - sum(out.values())
    return out
