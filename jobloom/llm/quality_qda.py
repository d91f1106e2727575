"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class is a normal density with its own mean and a shrinkage covariance
``(1 - a - b) S_class + a S_pooled + b diag(S_pooled)``. The sums behind them are taken over all labelled
documents that may be learnt from, not over a sample: a partition sends one small matrix a class. Scores
come from the difference of the two Mahalanobis log densities, with Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches
from .features import held_out, labelled_rows
from .words import WHITE, Words, batches_of_words

POOLED, DIAGONAL = 0.10, 0.05
#: The log-density difference is divided by this before the logistic function, and bounded.
_TEMPER, _BOUND = 4.0, 30.0

_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:'\"-()")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[0x21:0x7F] = True
_ODD &= ~(_UPPER | _LOWER | _DIGIT | _STOP | _MARK)
_CLASSES = (_UPPER, _DIGIT, _STOP, _MARK, _ODD)
NAMES = ("words", "word_length", "upper", "digits", "stops", "marks", "odd", "lone", "odd_ends", "repeats", "runs", "distinct", "lines", "capitals")


def statistics(words: Words) -> np.ndarray:
    """A row of transformed statistics for each text; shares are taken as log(share + 0.005)."""
    n = words.counts.astype(np.float64)
    safe = np.maximum(n, 1)
    size = np.maximum(np.diff(words.offsets).astype(np.float64), 1)
    first = words.first

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)

    length = words.end - words.start
    hashes = words.hashes()
    owner = words.owner()
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    run = same.copy()
    run[1:] &= same[:-1]
    head, tail = words.data[words.start], words.data[words.end - 1] if len(hashes) else words.data[:0]
    letters = np.maximum(per_text(_UPPER[words.data] | _LOWER[words.data], words.offsets), 1)
    shares = [
        per_text(_UPPER[words.data], words.offsets) / letters,
        *(per_text(c[words.data], words.offsets) / size for c in _CLASSES[1:]),
        per_text((length == 1) & _ODD[head], first) / safe,
        per_text(_ODD[tail] | _MARK[tail], first) / safe,
        per_text(same, first) / safe,
        per_text(run, first) / safe,
    ]
    out = [np.log1p(n), np.log(per_text(~WHITE[words.data], words.offsets) / safe + 1)]
    out += [np.log(s + 0.005) for s in shares]
    out.append(np.log((safe - per_text(again, first)) / safe ** 0.8 + 0.01))
    out.append(np.log1p(per_text(words.data == 0x0A, words.offsets) / safe * 10))
    out.append(np.log(per_text(_UPPER[head], first) / safe + 0.005))
    return np.stack(out, axis=1)


def _statistics_rows(words: Words) -> list[bytes]:
    return [row.tobytes() for row in statistics(words)]


@dataclass(frozen=True)
class Discriminant:
    """Log prior, mean, inverse Cholesky factor of the covariance and half its log determinant, of either class."""

    prior: tuple[float, float]
    mean: np.ndarray
    inverse: np.ndarray
    half_logdet: np.ndarray

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Discriminant | None:
        """From the rows, sums and sums of outer products of class 0 and 1; None if one has no rows."""
        if count.min() < 1:
            return None
        mean = total / count[:, None]
        scatter = outer - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(axis=0) / count.sum()
        ridge = np.diag(np.diag(pooled) + 1e-4)
        factor = []
        for k in (0, 1):
            own = scatter[k] / count[k]
            own = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * ridge
            factor.append(np.linalg.cholesky((own + own.T) / 2 + 1e-6 * np.eye(len(own))))
        factor = np.stack(factor)
        half = np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1)
        share = (count + 1) / (count.sum() + 2)
        return cls((float(np.log(share[0])), float(np.log(share[1]))), mean, np.linalg.inv(factor), half)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1, tempered: statistics of one text are not independent draws."""
        density = []
        for k in (0, 1):
            z = self.inverse[k] @ (x - self.mean[k]).T
            density.append(self.prior[k] - 0.5 * (z * z).sum(axis=0) - self.half_logdet[k])
        gap = np.clip((density[1] - density[0]) / _TEMPER, -_BOUND, _BOUND)
        return 1 / (1 + np.exp(-gap))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", modulus: int = 4, rest: int = 2) -> Discriminant | None:
    """Learns from all labelled documents whose crc32 remainder isn't ``rest``; None without both classes."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            label = batch.column("label").to_numpy()
            every = np.frombuffer(b"".join(batch.column("features").to_pylist())).reshape(-1, d)
            for k in (0, 1):
                own = every[label == k]
                count[k] += len(own)
                total[k] += own.sum(axis=0)
                outer[k] += own.T @ own
        values = np.concatenate([count, total.ravel(), outer.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    rows = labelled_rows(docs, _statistics_rows, WHITE, False, labels, target, id_col, modulus, rest).select("features", "label").mapInArrow(sums, "i long, v double")
    # decimal sums don't depend on their order
    out = rows.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,9)")).cast("double").alias("v")).orderBy("i").toArrow()
    values = out.column("v").to_numpy()
    if not len(values):
        return None
    return Discriminant.fit(values[:2], values[2 : 2 + 2 * d].reshape(2, d), values[2 + 2 * d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", target: str = "quality", modulus: int = 4, rest: int = 2, threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted): a row for each row of ``docs``.

    The score is the chance that the label is 1, from the text alone; a null text counts as empty, and an
    empty text has a score as well; a text is read whole however long it is, in one worker at once. Without
    labelled documents of both classes every score is 0.5, as nothing is known. A row with a null id is held
    out; labels other than 0 and 1 are not used; a document with both labels counts once for each; repeated
    documents each keep a row. Other columns of ``docs`` don't matter. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, target, id_col, modulus, rest)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in batches_of_words(batch.column("text"), WHITE, lower=False):
                score = np.full(hi - lo, 0.5) if shared.value is None else np.round(shared.value.score(statistics(words)), 9)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("id", "held_out")), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, modulus, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, f"`{id_col}` long, held_out boolean, score double, predicted int")
