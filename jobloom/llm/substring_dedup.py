"""Substring deduplication with difference-cover anchors.

Every residue modulo the period is a difference of two cover members, so for any two places where the
same ``window`` words stand there is one shift below the period that puts both on cover positions. With
anchors of ``window - period + 1`` words, hashed only at cover positions, equal windows therefore share
an anchor. Steps:

1. anchors of all texts -> smallest and largest document of each (combined before the shuffle); those
   of two documents or more are shared;
2. shared anchors set bits in a map of fixed size. A window is extended from each anchor whose bit is
   set; a false bit costs a needless window, never a wrong result;
3. windows (128-bit hash of their words) -> first document, again by minimum;
4. each document gets the windows that start in a smaller document and loses the words they cover.

No step gathers the occurrences of a window, so a passage in a third of all documents is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .cluster import Scratch
from .words import WHITE, WORD_BASE, WORD_BASE_2, Words, batches_of_words, int64, span_hash

#: Perfect difference sets (period: members).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Anchors of fewer words would be shared by chance.
LEAST_ANCHOR = 7
#: The map of shared anchors has this many bits (32 MB) whatever the input.
MAP_BITS = 28


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: the widest period that leaves anchors long enough."""
    period = max((p for p in COVERS if window - p + 1 >= LEAST_ANCHOR), default=1)
    return period, COVERS[period], window - period + 1


def _anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and hash of the anchors of all texts with a window, and the text of each."""
    period, cover, length = cover_for(window)
    starts = words.starts_with_room(length)
    owner = np.searchsorted(words.first, starts, side="right") - 1
    wanted = np.isin((starts - words.first[owner]) % period, cover) & (words.counts[owner] >= window)
    starts, owner = starts[wanted], owner[wanted]
    return starts, span_hash(hashes, starts, starts + length, WORD_BASE), owner


def _windows_at(words: Words, anchors: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that hold one of the anchors whole."""
    _, _, length = cover_for(window)
    mark = np.zeros(len(words.start) + 1, dtype=np.int64)
    lo = np.maximum(words.first[owner], anchors - (window - length))
    hi = np.minimum(anchors, words.first[owner + 1] - window)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]))


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, words in batches_of_words(batch.column("text"), WHITE, lower=False):
                _, hashes, owner = _anchors(words, words.hashes(), window)
                yield pa.RecordBatch.from_arrays([int64(hashes), pa.array(ids[lo:hi][owner])], ["anchor", "doc"])

    return docs.mapInArrow(emit, "anchor long, doc long")


def _shared_map(docs: DataFrame, window: int, scratch: Scratch) -> Bitmap:
    """The anchors of two documents or more."""
    shared = _anchor_rows(docs, window).groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    return Bitmap.of(shared, "anchor", MAP_BITS, scratch)


def _window_rows(docs: DataFrame, window: int, shared: Broadcast) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, words in batches_of_words(batch.column("text"), WHITE, lower=False):
                hashes = words.hashes()
                anchors, keys, owner = _anchors(words, hashes, window)
                hit = shared.value.holds(keys)
                starts = _windows_at(words, anchors[hit], owner[hit], window)
                owner = np.searchsorted(words.first, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [int64(span_hash(hashes, starts, starts + window, WORD_BASE)), int64(span_hash(hashes, starts, starts + window, WORD_BASE_2)), pa.array(ids[lo:hi][owner])],
                    ["w1", "w2", "doc"],
                )

    return docs.mapInArrow(emit, "w1 long, w2 long, doc long")


def _covered(words: Words, hashes: np.ndarray, text: int, found: np.ndarray, window: int) -> np.ndarray:
    """Which words of a text one of the windows found covers."""
    n = int(words.counts[text])
    starts = words.first[text] + np.arange(n - window + 1)
    hit = np.flatnonzero(np.isin(span_hash(hashes, starts, starts + window, WORD_BASE).view(np.int64), found))
    mark = np.zeros(n + 1, dtype=np.int64)
    mark[hit] += 1
    np.add.at(mark, hit + window, -1)
    return np.cumsum(mark[:-1]) > 0


def _cut(data: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words gone: each run goes with the white space after it, at the end with that before it."""
    out, at, n = [], 0, len(gone)
    flips = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    for first, last in zip(flips[::2], flips[1::2], strict=True):
        if last < n:
            out.append(data[at : start[first]])
            at = start[last]
        else:
            out.append(data[at : end[first - 1] if first else 0])
            at = len(data)
    return b"".join([*out, data[at:]])


def dedup_substrings(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with repeated passages cut from the text, plus ``n_words`` and ``n_removed``.

    Words are runs of other than white space (space, tab to carriage return). A word goes if a window of
    ``window`` words that covers it also starts in a document with a smaller id; windows are judged on
    the texts as given. Repeats inside one document stay, so of equal rows with one id all stay whole.
    A null text has no words and stays null; a text of fewer words than the window stays as it is; a text
    is cut whole however long it is, in one worker at once; a row with a null id is neither cut nor a reason to cut. Columns of ``docs`` that are named like the two
    new ones are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    shared = spark.sparkContext.broadcast(_shared_map(named, window, scratch))
    firsts = _window_rows(named, window, shared).groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    firsts = scratch.keep(firsts, "windows")
    later = _window_rows(named, window, shared).join(firsts, ["w1", "w2"]).where("doc > lo")
    found = scratch.keep(later.groupBy("doc").agg(F.collect_set("w1").alias("found")), "found")
    scratch.forget(firsts)

    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    packed = packed.join(found, packed["id"] == found["doc"], "left").select("text", "rest", "found")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column("text"), batch.column("found")
            known = column.is_valid().to_numpy(zero_copy_only=False)
            texts, n_words, n_removed = [], np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for lo, hi, words in batches_of_words(column, WHITE, lower=False):
                n_words[lo:hi] = words.counts
                raw = words.data.tobytes()
                hashes = None
                for text in range(hi - lo):
                    a, b = words.offsets[text], words.offsets[text + 1]
                    body = raw[a:b]
                    if lists[lo + text].is_valid and words.counts[text] >= window:
                        hashes = words.hashes() if hashes is None else hashes
                        gone = _covered(words, hashes, text, lists[lo + text].values.to_numpy(), window)
                        n_removed[lo + text] = gone.sum()
                        if n_removed[lo + text]:
                            span = slice(words.first[text], words.first[text + 1])
                            body = _cut(body, words.start[span] - a, words.end[span] - a, gone)
                    texts.append(body if known[lo + text] else None)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), batch.column("rest"), pa.array(n_words), pa.array(n_removed)], ["text", "rest", "n_words", "n_removed"])

    rest = packed.schema["rest"].dataType.simpleString()
    out = packed.mapInArrow(rewrite, f"text string, rest {rest}, n_words long, n_removed long")
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return out.select(*columns, "n_words", "n_removed")
