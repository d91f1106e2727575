"""Toxicity filter: a factorization machine over hashed terms.

A text is its set of lower-case words, hashed to a fixed number of buckets. Document frequencies of the
buckets by class, over all labelled documents that may be learnt from, pick the terms that tell the
classes apart alone (chi-square); terms that do so only in pairs are added, by a search for pairs that are
toxic more often than either term. However many they are, the machine then learns a weight for each term
and, by inner products of term factors, an interaction for each pair of them, such as an insult with a
group mention. Pairs are searched for, and the machine is fitted by Adagrad, on a bounded sample of the
labelled rows: ``SAMPLE_PER_CLASS`` of each class in expectation, the different rows whose hash is below the
share that this is of the class, weighted back to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch
from .features import held_out, labelled_rows
from .words import NOT_ALNUM, Words, batches_of_words

BUCKETS = 1 << 20
SAMPLE_PER_CLASS = 8_000
_HASH = 1 << 30
FACTORS = 8
#: The fit passes over its sample so often, whatever the sample's size, and takes so many gradient steps at least.
EPOCHS, LEAST_STEPS = 150, 4_000
#: A missed toxic text costs this many times a false alarm.
TOXIC_WEIGHT = 4.0
#: Chi-square below which a bucket tells nothing alone.
LEAST_CHI2 = 15.0
#: Chance of taking any pair of terms that tells no more than its terms.
PAIR_CHANCE = 0.05
_RATE, _L2_WEIGHT, _L2_FACTOR, _BATCH = 0.3, 2e-5, 2e-4, 128


def term_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, ordered by text, and where each text's begin."""
    bucket = (words.hashes() >> np.uint64(44)).astype(np.int64)
    key = np.unique(words.owner() * BUCKETS + bucket)
    owner = key // BUCKETS
    return key % BUCKETS, np.searchsorted(owner, np.arange(words.texts + 1))


def _term_rows(words: Words) -> list[bytes]:
    values, first = term_sets(words)
    return [row.tobytes() for row in np.split(values.astype(np.int32), first[1:-1])]


@dataclass(frozen=True)
class FactorizationMachine:
    """slot[bucket] is the bucket's row in the weights, or -1."""

    slot: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = self.slot[values]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[at >= 0]
        return self.bias + _output(self.weight, self.factor, at[at >= 0], owner, len(first) - 1)[0]


def _output(weight: np.ndarray, factor: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights plus pairwise interactions of each text's terms, and the sums of their factors."""
    linear = np.bincount(owner, weight[at], n)
    rows = factor[at]
    sums = np.stack([np.bincount(owner, rows[:, f], n) for f in range(factor.shape[1])], axis=1)
    squares = np.bincount(owner, (rows * rows).sum(axis=1), n)
    return linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def epochs(size: int) -> int:
    """Passes over a sample of ``size`` texts; a larger sample never gets fewer than ``EPOCHS``."""
    return max(EPOCHS, -(-LEAST_STEPS * _BATCH // max(size, 1)))


def fit(terms: np.ndarray, sets: list[np.ndarray], label: np.ndarray, importance: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """``sets`` hold numbers into ``terms``; ``importance`` weighs each text."""
    rng = np.random.Generator(np.random.PCG64(seed))
    weight, factor = np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), FACTORS))
    share = float((importance * label).sum() / importance.sum())
    bias = float(np.log(share / (1 - share)))
    past_w, past_f, past_b = np.full(len(terms), 1e-2), np.full(factor.shape, 1e-2), 1e-2
    for _ in range(epochs(len(sets))):
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), _BATCH):
            own = order[lo : lo + _BATCH]
            size = np.array([len(sets[i]) for i in own])
            at = np.concatenate([sets[i] for i in own]) if size.sum() else np.zeros(0, dtype=np.int64)
            owner = np.repeat(np.arange(len(own)), size)
            z, sums = _output(weight, factor, at, owner, len(own))
            gap = importance[own] * (1 / (1 + np.exp(-np.clip(bias + z, -30, 30))) - label[own]) / len(own)
            used, back = np.unique(at, return_inverse=True)
            g = gap[owner]
            d_w = np.bincount(back, g, len(used)) + _L2_WEIGHT * weight[used]
            inner = g[:, None] * (sums[owner] - factor[at])
            d_f = np.stack([np.bincount(back, inner[:, f], len(used)) for f in range(FACTORS)], axis=1) + _L2_FACTOR * factor[used]
            past_w[used] += d_w**2
            past_f[used] += d_f**2
            weight[used] -= _RATE * d_w / np.sqrt(past_w[used])
            factor[used] -= 0.3 * _RATE * d_f / np.sqrt(past_f[used])
            past_b += gap.sum() ** 2
            bias -= _RATE * gap.sum() / past_b**0.5
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[terms] = np.arange(len(terms))
    return FactorizationMachine(slot, bias, weight, factor)


def _chosen_terms(rows: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that tell the classes apart, and the number of rows of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            label, terms = batch.column("label").to_numpy(), batch.column("features").to_pylist()
            for k in (0, 1):
                own = [t for t, x in zip(terms, label, strict=True) if x == k]
                np.add.at(seen[k], np.frombuffer(b"".join(own), dtype=np.int32), 1)
                seen[k, BUCKETS] += len(own)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(seen[k, some]) for k in (0, 1))], ["bucket", "n0", "n1"])

    counts = rows.select("features", "label").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = scratch.keep(counts, "terms")
    whole = counts.where(F.col("bucket") == BUCKETS).first()
    sizes = np.array([whole.n0, whole.n1] if whole else [0, 0])
    if not sizes.all():
        return np.zeros(0, dtype=np.int64), sizes
    n0, n1 = (float(x) for x in sizes)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    top = F.pow(a * (n0 - b) - b * (n1 - a), 2) * (n0 + n1)
    best = counts.where(F.col("bucket") < BUCKETS).withColumn("chi2", top / (n0 * n1 * (a + b) * (n0 + n1 + 1e-9 - a - b)))
    best = best.where(F.col("chi2") >= LEAST_CHI2)
    return np.sort(best.select("bucket").toArrow().column("bucket").to_numpy()), sizes


def paired_terms(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Buckets, from sets of them, that are toxic more often in some pair than either bucket is.

    A pair in m texts, a share p of them toxic, counts if ``m * KL(p, q)`` reaches the logarithm of the
    number of pairs over ``PAIR_CHANCE``, where q is the greatest toxic share of its buckets and of all
    texts: Chernoff's bound for so many toxic texts, over all pairs at once.
    """
    terms, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n1 = np.bincount(at[label[owner] == 1], minlength=len(terms))
    share = np.maximum(n1 / np.maximum(np.bincount(at), 1), label.mean())
    wanted = np.log(max(len(terms), 2) ** 2 / 2 / PAIR_CHANCE)
    # no pair passes that could not if all of a bucket's toxic texts, and no others, held it
    able = -n1 * np.log(share) >= wanted
    if not able.any():
        return terms[able]
    number, terms, sure = np.cumsum(able) - 1, terms[able], -np.log(share[able])
    at, owner = number[at[able[at]]], owner[able[at]]
    rows = np.split(at, np.searchsorted(owner, np.arange(1, len(sets))))
    order = np.argsort(at, kind="stable")
    found = np.zeros(len(terms), dtype=bool)
    for i, texts in enumerate(np.split(owner[order], np.searchsorted(at[order], np.arange(1, len(terms))))):
        n1 = np.bincount(np.concatenate([rows[t] for t in texts if label[t]]), minlength=len(terms))
        q = np.minimum(sure, sure[i])
        other = np.flatnonzero(n1 * q >= wanted)
        other = other[other > i]
        if len(other):
            n0 = np.bincount(np.concatenate([rows[t][:0] if label[t] else rows[t] for t in texts]), minlength=len(terms))[other]
            n1, q = n1[other], np.exp(-q[other])
            p = n1 / (n0 + n1)
            apart = n1 * np.log(p / q) + n0 * np.log(np.maximum(1 - p, 1e-300) / (1 - q))
            other = other[(p > q) & (apart >= wanted)]
            found[other] = True
            found[i] |= len(other) > 0
    return terms[found]


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", modulus: int = 3, rest: int = 1) -> FactorizationMachine | None:
    """Learns from labelled documents whose crc32 remainder isn't ``rest``; None without both classes, in the sample too."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(labelled_rows(docs, _term_rows, NOT_ALNUM, True, labels, target, id_col, modulus, rest), "labelled")
    alone, sizes = _chosen_terms(rows, scratch)
    if not sizes.all():
        return None
    share = [min(1.0, SAMPLE_PER_CLASS / n) for n in sizes]
    below = F.when(F.col("label") == 1, int(share[1] * _HASH)).otherwise(int(share[0] * _HASH))
    chosen = rows.where(F.pmod(F.xxhash64("id", "features"), F.lit(_HASH)) < below).select("id", "label", "features").distinct()
    sample = chosen.toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("features", "ascending")])
    label = sample.column("label").to_numpy()
    texts = [np.frombuffer(x, dtype=np.int32) for x in sample.column("features").to_pylist()]
    terms = np.union1d(alone, paired_terms(texts, label)).astype(np.int64)
    sets = [np.searchsorted(terms, x[np.isin(x, terms, assume_unique=True)]) for x in texts]
    taken = np.array([(label == k).sum() for k in (0, 1)])
    if not taken.all():
        return None
    importance = (sizes / sizes.sum() * taken.sum() / taken * (1.0, TOXIC_WEIGHT))[label]
    scratch.forget(rows)
    return fit(terms, sets, label, importance)


def _scores(batch: pa.RecordBatch, shared: Broadcast) -> Iterator[tuple[int, int, np.ndarray]]:
    model = shared.value
    for lo, hi, words in batches_of_words(batch.column("text"), NOT_ALNUM, lower=True):
        if model is None:
            yield lo, hi, np.full(hi - lo, 0.5)
        else:
            yield lo, hi, np.round(1 / (1 + np.exp(-np.clip(model.logits(*term_sets(words)), -30, 30))), 9)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", modulus: int = 3, rest: int = 1, threshold: float = 0.7, returned: list[str] | None = None) -> DataFrame:
    """The columns of ``docs``, or those ``returned``, plus ``held_out``, ``score`` and ``predicted``.

    The score is the chance that the label is 1, from the text alone; a null or empty text has the score
    of the bias; a text is read whole however long it is, in one worker at once. Without labelled documents
    of both classes every score is 0.5, as nothing is known, and nothing is rejected; repeated documents each keep a row. A row with a null id is held
    out; labels other than 0 and 1 are not used; a document with both labels counts once for each. Columns
    of ``docs`` named like the new ones are replaced. An empty table gives an empty result.
    """
    new = ("held_out", "score", "predicted")
    returned = [c for c in (docs.columns if returned is None else returned) if c not in new]
    others, text_back = [c for c in returned if c != text_col], text_col in returned
    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(source, labels, target, id_col, modulus, rest))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"), held_out(id_col, modulus, rest).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    kept = ["rest", "held_out", *(["text"] if text_back else [])]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, score in _scores(batch, shared):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    out = rows.mapInArrow(emit, f"rest {rows.schema['rest'].dataType.simpleString()}, held_out boolean, {'text string, ' if text_back else ''}score double, predicted int")
    return out.select(*[F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in returned], *new)
