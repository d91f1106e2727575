"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Item words are numbered and written with a fixed number of characters, each place in a word with characters
of its own, so that the automaton, which scans a text once, reports word-aligned places only. Its patterns
are not all windows of an item, which overlap, but every ``step``-th stretch of ``window - step + 1`` words:
each window holds one of them whole and is found by extending it in the text and the item. So the automaton
has about three nodes (some 120 bytes) for each word of the benchmark. Hits map back to word numbers and
to byte offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches
from .words import LOWER, NOT_ALNUM, Words, batches_of_words

_TO_SPACE = LOWER.copy()
_TO_SPACE[NOT_ALNUM[LOWER]] = 0x20
_TABLE = _TO_SPACE.tobytes()
#: Characters for one place of a word's code.
_DIGITS = 64


def normalised_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or "").encode().translate(_TABLE).split()


def _in_order(items: set[str | None]) -> list[str | None]:
    """Sorted, a null id last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


@dataclass(frozen=True)
class Items:
    """Test items as word numbers, and the places of the stretches that the automaton looks for."""

    window: int
    ids: list[str | None]
    words: list[np.ndarray]
    hashes: np.ndarray
    numbers: np.ndarray
    width: int
    places: dict[str, list[tuple[int, int]]]

    @classmethod
    def read(cls, items: list[tuple[str | None, str | None]], window: int) -> Items:
        """Items of fewer words than the window, but not none, are one stretch."""
        cut = [(i, w) for i, t in items if (w := normalised_words(t))]
        known = sorted({x for _, w in cut for x in w})
        number = {x: n for n, x in enumerate(known)}
        raw = b" ".join(known)
        hashes = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), NOT_ALNUM, lower=False).hashes()
        order = np.argsort(hashes)
        width = 1
        while _DIGITS**width < len(known):
            width += 1
        out = cls(window, [i for i, _ in cut], [np.array([number[x] for x in w], dtype=np.int64) for _, w in cut], hashes[order], order, width, {})
        step = (window + 1) // 2
        for at, words in enumerate(out.words):
            code = out.code(words)
            short = len(words) < window
            size = len(words) if short else window - step + 1
            for j in range(0, len(words) - size + 1, step):
                out.places.setdefault(code[j * width : (j + size) * width], []).append((at, j))
        return out

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word by its hash, -1 for words that no item has."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def code(self, numbers: np.ndarray) -> str:
        digits = np.empty((len(numbers), self.width), dtype=np.uint32)
        for place in range(self.width):
            digits[:, place] = place * _DIGITS + numbers // _DIGITS**place % _DIGITS
        digits[numbers < 0] = self.width * _DIGITS
        return digits.tobytes().decode("utf-32-le")

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for key, places in self.places.items():
            found.add_word(key, (len(key) // self.width, places))
        found.make_automaton()
        return found

    def hits(self, text: np.ndarray, automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str | None]]:
        """(first word, last word + 1) of the stretches of a text that windows cover, and the items they are of."""
        spans: set[tuple[int, int]] = set()
        items: set[str | None] = set()
        if not len(automaton):
            return [], items
        for end, (size, places) in automaton.iter(self.code(text)):
            last = (end + 1) // self.width
            first = last - size
            for at, j in places:
                words = self.words[at]
                a = b = 0
                while a < min(self.window - size, j, first) and words[j - a - 1] == text[first - a - 1]:
                    a += 1
                while b < min(self.window - size, len(words) - j - size, len(text) - last) and words[j + size + b] == text[last + b]:
                    b += 1
                if a + size + b >= min(self.window, len(words)):
                    spans.add((first - a, last + b))
                    items.add(self.ids[at])
        return sorted(spans), items


_numbers = count()
#: The automaton that this worker built last, by the number of the driver's call.
_built: dict[int, ahocorasick.Automaton] = {}


def _automaton_of(shared: Broadcast, number: int) -> ahocorasick.Automaton:
    if number not in _built:
        _built.clear()
        _built[number] = shared.value.automaton()
    return _built[number]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", returned: list[str] | None = None) -> DataFrame:
    """The columns of ``docs``, or those ``returned``, plus ``n_words``, ``n_hit``, ``items``, ``offsets`` and ``contaminated``.

    A window is ``window`` consecutive words of an item, or all words of an item with fewer, but not
    none. A document word inside any occurrence of a window is hit; ``items`` are the ids, as sorted
    strings, of the items with occurring windows, with one null at the end for all items with a null id;
    ``offsets`` are the hit stretches as byte offsets (start, end) of the UTF-8 text. A document is
    contaminated if a word is hit and ``20 * n_hit >= n_words``. A null text has no words; a text is scanned
    whole however long it is, in one worker at once; repeated documents each keep a row; items with a null
    text and an empty benchmark hit nothing; repeated items count once. Columns of ``docs`` named like the new ones
    are replaced. An empty table gives an empty result. The driver and each worker hold the benchmark, which
    doesn't grow with the documents, at some 120 bytes a word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct().toLocalIterator()
    shared = spark.sparkContext.broadcast(Items.read([(r.i, r.t) for r in rows], window))
    number = next(_numbers)
    new = ("n_words", "n_hit", "items", "offsets", "contaminated")
    returned = [c for c in (docs.columns if returned is None else returned) if c not in new]
    others = [c for c in returned if c != text_col]
    text_back = text_col in returned
    state = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rest = state.schema["rest"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, automaton = shared.value, _automaton_of(shared, number)
        for batch in batches:
            n_words, n_hit, names, offsets = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64), [[]] * len(batch), [[]] * len(batch)
            for lo, hi, words in batches_of_words(batch.column("text"), NOT_ALNUM, lower=True):
                numbers = items.numbered(words.hashes())
                n_words[lo:hi] = words.counts
                for text in range(hi - lo):
                    a, b = words.first[text], words.first[text + 1]
                    spans, found = items.hits(numbers[a:b], automaton)
                    if spans:
                        merged = _merged(spans)
                        n_hit[lo + text] = sum(y - x for x, y in merged)
                        names[lo + text] = _in_order(found)
                        begin = words.offsets[text]
                        offsets[lo + text] = [{"start": int(words.start[a + x] - begin), "end": int(words.end[a + y - 1] - begin)} for x, y in merged]
            columns = [batch.column("rest"), *([batch.column("text")] if text_back else []), pa.array(n_words), pa.array(n_hit), pa.array(names, pa.list_(pa.string())), pa.array(offsets, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["rest", *(["text"] if text_back else []), "n_words", "n_hit", "items", "offsets"])

    out = state.mapInArrow(scan, f"rest {rest}, {'text string, ' if text_back else ''}n_words long, n_hit long, items array<string>, offsets array<struct<start:long,end:long>>")
    columns = [F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in returned]
    return out.select(*columns, "n_words", "n_hit", "items", "offsets", F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out
