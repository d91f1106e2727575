from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD, ascii_lower

from jobloom.llm import ctw
from jobloom.llm.ctw import DEPTH, Table, log_kt, score_texts


def _steps(text):
    b = [255] * DEPTH + list(text.encode()) + [255]
    for p in range(DEPTH, len(b)):
        context, node = b[p - DEPTH : p][::-1], 1
        for k in range(7, -1, -1):
            bit = b[p] >> k & 1
            yield context, node, bit
            node = node * 2 + bit


def _brute(docs):
    """{id: (n_tokens, n_known, N, base, score)} with a dictionary for each context node."""
    train = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    cut = lambda t: [*WORD.findall(ascii_lower(t)), None]
    words = Counter(w for t in train for w in cut(t))
    total, kinds = sum(words.values()), len(words)
    counts = defaultdict(lambda: [0, 0])
    for t in train:
        for context, node, bit in _steps(t):
            for d in range(DEPTH + 1):
                counts[tuple(context[:d]), node][bit] += 1
    g = math.lgamma
    own = {k: g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1) for k, (a, b) in counts.items()}
    mixed, children = {}, defaultdict(float)
    for d in range(DEPTH, -1, -1):
        for (c, n), o in own.items():
            if len(c) == d:
                mixed[c, n] = o if d == DEPTH else float(np.logaddexp(o, children[c, n])) + math.log(0.5)
                children[c[:-1], n] += mixed[c, n] if d else 0

    def predict(context, node, bit):
        p = 0.5
        for d in range(DEPTH, -1, -1):
            k = tuple(context[:d]), node
            n = counts.get(k, [0, 0])
            w = 1.0 if d == DEPTH else math.exp(math.log(0.5) + own[k] - mixed[k]) if k in own else 0.5
            p = w * (n[bit] + 0.5) / (sum(n) + 1) + (1 - w) * p
        return p

    out = []
    for i, t in docs:
        w = cut(t)
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        out.append((i, len(w), sum(words[x] > 0 for x in w), total, base, sum(math.log10(predict(*s)) for s in _steps(t))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, monkeypatch, small):
    if small:  # nearly everything takes the way of rare rows
        monkeypatch.setattr(ctw, "GRAM_TABLE", 5)
        monkeypatch.setattr(ctw, "TOKEN_TABLE", 2)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "Thé", "cat", "sat", "x😀", "\x00"]) for _ in range(rng.randrange(12)))) for i in range(30)] + [(30, ""), (None, "the odd"), (7, "the cat"), (7, "the cat")]
    frame = spark.createDataFrame([(i, t or None, "x") for i, t in docs], "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_texts(frame).collect()), key=str)
    for a, b in zip(got, sorted(_brute(docs), key=lambda r: str((*r[:4], round(r[4], 6)))), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5)
    assert score_texts(frame.limit(0)).collect() == []


def test_is_a_distribution(spark):
    """Over all next bytes of a context the probabilities add up to one."""
    keys = np.array([(0x6162636465 << 8) | b for b in range(256)], dtype=np.uint64) if DEPTH == 5 else None
    n = np.zeros(256, dtype=np.int64)
    n[[97, 98]] = 5, 9
    tree = ctw.Tree(keys, n)
    upper = ctw.Upper(*tree.passed_up())
    assert (10 ** tree.log10_byte(upper)).sum() == pytest.approx(1)


def test_texts_without_words(spark):
    """Null, empty and blank texts, alone and beside very long ones."""
    blank = [(1, None), (2, ""), (3, " \n\t "), (None, None)]
    for docs in (blank, [(4, "word " * 300_000), (5, "x" * 1_200_000), *blank]):
        out = {r.doc_id: r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert len(out) == len(docs) and all(out[i].n_tokens == 1 for i in (1, 2, 3, None))
        assert out[1].score == out[2].score == out[None].score < 0
    assert out[4].n_tokens == 300_001 and out[5].n_tokens == 2


def test_blocks_are_whole_contexts(spark, monkeypatch):
    """Blocks of a few grams give the scores of one block; a block ends where three context bytes change."""
    docs = spark.createDataFrame([(i, f"{'abra cadabra ' * (i % 5)} {i}") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, score_texts(docs).collect()))
    monkeypatch.setattr(ctw, "_BLOCK", 3)
    assert sorted(map(tuple, score_texts(docs).collect())) == want
    key = np.sort(np.random.default_rng(2).integers(0, 9, 500).astype(np.uint64)) << np.uint64(8)
    batch = ctw.pa.RecordBatch.from_arrays([ctw.int64(key), ctw.pa.array(np.ones(500, dtype=np.int64))], ["key", "n"])
    parts = [k for k, _ in ctw._blocks(iter([batch.slice(i, 7) for i in range(0, 500, 7)]), 3)]
    assert (np.concatenate(parts) == key).all() and len(parts) > 1 and all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_table_and_estimator():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    table = Table(keys, np.arange(5000.0))
    values, there = table.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (values[:5000] == np.arange(5000)).all() and there[:5000].all() and not there[5000:].any()
    assert Table(keys[:0], np.zeros(0)).find(keys)[1].sum() == 0
    for a, b in ((0, 0), (3, 5), (4095, 1), (5000, 70), (10**7, 3)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        assert log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(want, abs=1e-6 * max(1, a))
