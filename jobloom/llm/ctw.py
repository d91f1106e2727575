"""Language-model scoring by context-tree weighting over bytes.

A text is the sequence of its UTF-8 bytes and one end symbol (0xFF, which UTF-8 never uses); its context
starts with end symbols. Each byte is eight binary decisions, and each of the 255 decision nodes of a
byte has its own context tree over the ``DEPTH`` bytes before. A tree node mixes, half and half, the
Krichevsky-Trofimov estimate from its own counts with the product of its children, so a prediction mixes
the estimates of all depths by how well they coded the training corpus.

All counts follow from those of byte grams (context and next byte) of the training documents:

1. gram and token counts over the whole corpus, combined before the shuffle;
2. grams are dealt by the three most recent context bytes, under which the deeper subtrees are closed, and
   sorted by them, so that a worker holds a block of whole contexts at a time and no partition; what the
   blocks pass up for the depths above is a row for each two bytes and decision node seen (65,536 x 255 at
   most, of which UTF-8 text has a small part);
3. weights go down again and give log10 P(byte | context) for every gram that occurs in any document;
4. texts are scored against a table of the most frequent grams and tokens, whose size is fixed; what the
   table lacks is emitted as rows and joined with the full tables. Nothing is left out at any size.

The unigram base score uses the same tables for its token counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch
from .features import held_out
from .words import WHITE, Words, int64, mix64, pieces, text_buffers

DEPTH = 5
#: Entries of the tables that every worker holds.
GRAM_TABLE, TOKEN_TABLE = 1 << 20, 1 << 18
_END = 0xFF
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_COUNT_PIECE, _SCORE_PIECE = 1 << 20, 1 << 18
#: Rows in one batch to the JVM, which holds batches outside its heap.
_BATCH_ROWS = 1 << 15
#: Counts that a worker holds before it adds them up and hands them on.
_HELD_ROWS = 1 << 19
#: Grams that the trees of a worker hold; one context of three bytes may have more.
_BLOCK = 1 << 17
_SMALL = 4096
_LOG_GAMMA = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))))
_LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _SMALL + 1)))))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""

    def rise(n: np.ndarray) -> np.ndarray:  # log of Gamma(n + 1/2) / Gamma(1/2)
        return np.where(n < _SMALL, _LOG_GAMMA[np.minimum(n, _SMALL)], _stirling(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi))

    n = zeros + ones
    return rise(zeros) + rise(ones) - np.where(n < _SMALL, _LOG_FACTORIAL[np.minimum(n, _SMALL)], _stirling(n + 1.0))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram of each byte and end symbol (oldest context byte highest), and where each text's begin."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(data) + n * (DEPTH + 1), _END, dtype=np.uint64)
    owner = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + owner * (DEPTH + 1) + DEPTH] = data
    key = np.zeros(max(len(padded) - DEPTH, 0), dtype=np.uint64)
    for i in range(DEPTH + 1):
        key = (key << _U(8)) | padded[i : len(padded) - DEPTH + i]
    first = offsets - offsets[0] + np.arange(n + 1)
    at = np.arange(int(first[-1])) + np.repeat(np.arange(n), size + 1) * DEPTH
    return key[at], first


class Tree:
    """Context nodes of depth 3 to DEPTH for all grams under some most recent byte triples.

    The eight decisions of a byte have trees of their own and are worked on one after the other.
    """

    def __init__(self, gram: np.ndarray, count: np.ndarray) -> None:
        self.byte, self.context, self.count = (gram & _U(0xFF)).astype(np.int64), (gram >> _U(8)).astype(np.int64), count
        #: By depth: an order in which equal contexts, then equal bytes meet, and the keys in that order.
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for depth in range(DEPTH, 1, -1):
            key = ((self.context & ((1 << (8 * depth)) - 1)) << 8) | self.byte
            order = np.argsort(key, kind="stable")
            self.sorted[depth] = order, key[order]

    def nodes(self, depth: int, level: int) -> np.ndarray:
        """The number, from 0, of each gram's node of a depth and decision."""
        order, key = self.sorted[depth]
        own = key >> (8 - level)
        at = np.empty(len(key), dtype=np.int64)
        at[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1]))) if len(key) else 0
        return at

    def decision(self, level: int) -> np.ndarray:
        return (1 << level) | (self.byte >> (8 - level))

    def levels(self) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[np.ndarray, ...]]]]:
        """For each decision: its number, each gram's bit, and by depth (node of each gram, zeros, ones, own log, mixed log)."""
        for level in range(8):
            bit = (self.byte >> (7 - level)) & 1
            depths: dict[int, tuple[np.ndarray, ...]] = {}
            for depth in range(DEPTH, 2, -1):
                at = self.nodes(depth, level)
                ones = np.bincount(at, self.count * bit).astype(np.int64)
                zeros = np.bincount(at, self.count).astype(np.int64) - ones
                own = mixed = log_kt(zeros, ones)
                if depth < DEPTH:
                    below, *_, log_mixed = depths[depth + 1]
                    mixed = np.logaddexp(own, _to_parents(below, at, log_mixed)) + np.log(0.5)
                depths[depth] = at, zeros, ones, own, mixed
            yield level, bit, depths

    def passed_up(self) -> tuple[np.ndarray, ...]:
        """(key, zeros, ones, mixed log) of depth 3 added up by two context bytes and decision node; key is ``context << 8 | node``."""
        parts = []
        for level, _, depths in self.levels():
            at, zeros, ones, _, mixed = depths[3]
            above = self.nodes(2, level)
            key = np.zeros(int(above.max(initial=-1)) + 1, dtype=np.int64)
            key[above] = ((self.context & 0xFFFF) << 8) | self.decision(level)
            parts.append((key, *(_to_parents(at, above, x) for x in (zeros, ones, mixed))))
        key, zeros, ones, mixed = (np.concatenate(x) for x in zip(*parts, strict=True))
        return key, zeros.astype(np.int64), ones.astype(np.int64), mixed

    def log10_byte(self, upper: Upper) -> np.ndarray:
        """log10 P(byte | context) of each gram."""
        out = np.zeros(len(self.byte))
        for level, bit, depths in self.levels():
            p = None
            for depth in range(DEPTH, 2, -1):
                at, zeros, ones, log_own, log_mixed = depths[depth]
                own = ((np.where(bit, ones[at], zeros[at])) + 0.5) / (zeros + ones + 1)[at]
                if p is None:
                    p = own
                else:
                    w = np.exp(np.log(0.5) + log_own - log_mixed)[at]
                    p = w * own + (1 - w) * p
            key = ((self.context & 0xFFFF) << 8) | self.decision(level)
            for zeros, ones, w in upper.at(key):
                p = w * (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1) + (1 - w) * p
            out += np.log10(p)
        return out


def _to_parents(child: np.ndarray, parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of child nodes added up by parent, from the nodes of each gram; a child counts once."""
    of = np.zeros(len(values), dtype=np.int64)
    of[child] = parent
    return np.bincount(of, values, int(parent.max(initial=-1)) + 1)


class Upper:
    """Counts and weights of the nodes of depth 0 to 2, from what the trees pass up."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, mixed: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, half = key[order], np.log(0.5)
        self.levels = []
        children, counts = mixed[order], (zeros[order], ones[order])
        for above in (self.key & 0xFFFF, np.arange(1 << 16) & 0xFF, None):
            own = log_kt(*counts)
            whole = np.logaddexp(own, children) + half
            self.levels.append((*counts, np.exp(half + own - whole)))
            if above is not None:
                size = 1 << 16 if len(self.levels) == 1 else 1 << 8
                children = np.bincount(above, whole, size).astype(np.float64)
                counts = tuple(np.bincount(above, x, size).astype(np.int64) for x in counts)

    def at(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(zeros, ones, weight) of the nodes of depth 2, 1 and 0 above each key."""
        for (zeros, ones, w), place in zip(self.levels, (np.searchsorted(self.key, key), key & 0xFFFF, key & 0xFF), strict=True):
            yield zeros[place], ones[place], w[place]


class Table:
    """Fixed keys with values, looked up for whole arrays; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = keys[keys != _NONE], values[keys != _NONE]
        self.bits = max(4, (len(keys) * 3 // 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == _NONE
            self.keys[at[free]] = keys[left[free]]
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where a key is missing, and whether each is there."""
        at = self._home(keys)
        seen = self.keys[at]
        there = seen == keys
        values = np.where(there, self.values[at], 0.0)
        left = np.flatnonzero(~there & (seen != _NONE))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == keys[left]
            values[left[hit]] = self.values[at[hit]]
            there[left[hit]] = True
            go = ~hit & (seen != _NONE)
            left, at = left[go], at[go]
        there &= keys != _NONE
        return values, there


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys once each, with their counts added up."""
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _count_rows(docs: DataFrame) -> DataFrame:
    """(kind, key, n): tokens (0) of training texts; grams (1) of all texts, n = 0 outside training."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = _summed(held[kind])
            held[kind], size[kind] = [], 0
            for lo in range(0, len(keys), _BATCH_ROWS):
                part = slice(lo, lo + _BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, dtype=np.int32)), int64(keys[part]), pa.array(n[part])], ["kind", "key", "n"])

        for batch in batches:
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in pieces(offsets, _COUNT_PIECE):
                own, span = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                key, first = grams(own, span)
                learn = np.repeat(train[lo:hi], np.diff(first))
                words = Words(own, span, WHITE, lower=True)
                tokens = words.hashes()[np.repeat(train[lo:hi], words.counts)]
                for kind, values, counted in ((0, tokens, True), (1, key[learn], True), (1, key[~learn], False)):
                    u, n = np.unique(values, return_counts=True)
                    held[kind].append((u, n * counted))
                    size[kind] += len(u)
                    if size[kind] >= _HELD_ROWS:
                        yield from out(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from out(kind)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(emit, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts, sorted by three context bytes, in blocks of at least ``least`` that end where a context does."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, full = 0, least
    for batch in batches:
        held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
        size += len(batch)
        if size >= full:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            context = key >> _U(8) & _U(0xFFFFFF)
            ends = np.flatnonzero(context[1:] != context[:-1]) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield key[:cut], n[:cut]
            held, size = [(key[cut:], n[cut:])], len(key) - cut
            full = max(least, 2 * size)
    if size:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield key, n


def _byte_model(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, log10p, n) of every gram."""
    block = _BLOCK
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("context")
    dealt = counts.select("key", "n", context).repartition("context").sortWithinPartitions("context").select("key", "n")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _blocks(batches, block):
            at, zeros, ones, mixed = Tree(key, n).passed_up()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(zeros), pa.array(ones), pa.array(mixed)], ["at", "zeros", "ones", "mixed"])

    passed = dealt.mapInArrow(up, "at long, zeros long, ones long, mixed double")
    passed = scratch.keep(passed.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")]), "passed")
    nodes = passed.toArrow()
    scratch.forget(passed)
    shared = counts.sparkSession.sparkContext.broadcast(Upper(*(nodes.column(c).to_numpy() for c in ("at", "zeros", "ones", "mixed"))))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _blocks(batches, block):
            yield pa.RecordBatch.from_arrays([int64(key), pa.array(Tree(key, n).log10_byte(shared.value)), pa.array(n)], ["key", "log10p", "n"])

    return dealt.mapInArrow(down, "key long, log10p double, n long")


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """All rows with at least the smallest power of two that at most ``most`` rows reach."""
    power = F.length(F.bin("n"))
    by_power = {r.p: r.rows for r in counts.where("n > 0").groupBy(power.alias("p")).agg(F.count("*").alias("rows")).collect()}
    total, least = 0, 64
    for p in sorted(by_power, reverse=True):
        if total + by_power[p] > most:
            break
        total, least = total + by_power[p], p
    return counts.where((F.col("n") > 0) & (power >= least))


_SCAN = "row long, kind int, key long, id long, held_out boolean, bytes long, tokens long, known long, base double, score double"


def _scan(docs: DataFrame, byte_table: Broadcast, token_table: Broadcast) -> DataFrame:
    """A row of sums (kind 0) for each text; a row for each token (1) and gram (2) that the tables lack."""
    names = [c.split()[0] for c in _SCAN.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in pieces(offsets, _SCORE_PIECE):
                own, span, n = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
                words = Words(own, span, WHITE, lower=True)
                sums = []
                for kind, keys, first, table in ((1, words.hashes(), words.first, token_table), (2, *grams(own, span), byte_table)):
                    values, there = table.value.find(keys)
                    owner = np.repeat(np.arange(n), np.diff(first))
                    # of no values numpy adds whole numbers
                    sums += [np.bincount(owner, x, n).astype(np.float64) for x in (values, there)]
                    every = np.flatnonzero(~there)
                    for lost in np.split(every, range(_BATCH_ROWS, len(every), _BATCH_ROWS)):
                        empty = [pa.nulls(len(lost), t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)]
                        yield pa.RecordBatch.from_arrays([pa.array(row[lo:hi][owner[lost]]), pa.array(np.full(len(lost), kind, dtype=np.int32)), int64(keys[lost]), *empty], names)
                base, known, score, _ = sums
                given = [batch.column(c).slice(lo, n) for c in ("id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[lo:hi]), pa.array(np.zeros(n, dtype=np.int32)), pa.nulls(n, pa.int64()), *given, pa.array(np.diff(span)), pa.array(words.counts.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                    names,
                )
        pa.default_memory_pool().release_unused()

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "held_out", "text").mapInArrow(emit, _SCAN)


def score_texts(docs: DataFrame, id_col: str = "doc_id", modulus: int = 10, rest: int = 0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    Learns from the rows whose crc32 remainder isn't ``rest``. ``score`` is the model's log10 probability
    of the text's bytes and its end, ``bits_per_byte`` the code length that this gives per byte.
    ``base_score`` is the additively smoothed unigram log10 probability of its lower-case tokens, the end
    counted as one. A null or empty text, or one without words, has a score as well, that of its bytes and
    its end; a text is scored whole however long it is, and its bytes are in one worker at once; a row with
    a null id is held out; repeated rows each count and each keep a row; without training rows every estimate is its prior. Other
    columns of ``docs`` don't matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, modulus, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = scratch.keep(_count_rows(texts), "counts")
    tokens = counts.where("kind = 0").select("key", "n")
    model = scratch.keep(_byte_model(counts.where("kind = 1"), scratch), "model")

    learnt = texts.where("not held_out").count()
    seen = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = seen.n + learnt, seen.v + (learnt > 0)
    below = total + 0.1 * (kinds + 1)

    frequent = _frequent(tokens, TOKEN_TABLE).toArrow()
    token_table = spark.sparkContext.broadcast(Table(frequent.column("key").to_numpy().view(np.uint64), np.log10((frequent.column("n").to_numpy() + 0.1) / below)))
    frequent = _frequent(model, GRAM_TABLE).select("key", "log10p").toArrow()
    byte_table = spark.sparkContext.broadcast(Table(frequent.column("key").to_numpy().view(np.uint64), frequent.column("log10p").to_numpy()))

    scan = scratch.keep(_scan(texts, byte_table, token_table), "scan")
    rare = scan.where("kind = 1").select("row", "key").join(tokens, "key", "left")
    rare = rare.select("row", F.coalesce((F.col("n") > 0).cast("long"), F.lit(0)).alias("known"), F.log10((F.coalesce("n", F.lit(0)) + 0.1) / below).alias("base"), F.lit(0.0).alias("score"))
    deep = scan.where("kind = 2").select("row", "key").join(model, "key").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("log10p").alias("score"))
    sums = rare.union(deep).groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")])
    out = scan.where("kind = 0").join(sums, "row", "left")
    end = float(np.log10((learnt + 0.1) / below))
    known, base, score = (F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("known", "base", "score"))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        (F.col("tokens") + 1).alias("n_tokens"),
        (known + int(learnt > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.round(base + end, 6).alias("base_score"),
        F.round(score, 6).alias("score"),
        F.round(-score / float(np.log10(2)) / (F.col("bytes") + 1), 6).alias("bits_per_byte"),
    )
