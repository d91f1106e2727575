"""Near-duplicate documents: MinHash bands, verification, connected components.

1. Each text gets its number of distinct shingles, a 128-bit fingerprint of the shingle set, and the
   minima of many universal hashes. Equal sets collapse to the document with the smallest id.
2. Bands of the signature put the remaining documents in buckets. In each bucket every member is paired
   with two of its members, the smallest and one by chance; pairs whose set sizes and signatures allow the
   similarity are confirmed on the full shingle sets; alternating large-star and small-star finds the
   components.
3. A bucket may still hold members of several components. There members outside the bucket's largest
   component are compared with all others of another component, inside a join's condition: sizes, then
   packed signatures, then the shingle sets, and each pair in its first common bucket only. What passes,
   which is few after the stars, is confirmed on the texts, and the components are found again. So each
   pair that shares a bucket is confirmed, refuted or within one component already, no pair is emitted for
   being in one group, and a large bucket is cut into blocks of bounded work.

With 40 bands of 5 minima a pair at similarity 0.8 shares no bucket with probability 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch
from .components import connected_components
from .words import WHITE, WORD_BASE, Words, batches_of_words, int64, mix64, span_hash

BANDS, ROWS = 40, 5
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
#: Standard errors by which a signature may fall short of the similarity before its pair is dropped.
_SLACK = 5.0
#: Comparisons in a bucket from which on it is cut into blocks, and in a block.
_PAIRS = 1 << 21


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by text, and where each text's begin.

    A text of fewer words than ``size``, but not none, has its whole sequence as one shingle.
    """
    hashes = words.hashes()
    starts = words.starts_with_room(size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    all_starts = np.concatenate([starts, words.first[short]])
    ends = np.concatenate([starts + size, words.first[short + 1]])
    values = span_hash(hashes, all_starts, ends, WORD_BASE)
    owner = np.searchsorted(words.first, all_starts, side="right") - 1
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(words.texts + 1))


def _signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of 32-bit minima for each text; texts must not be empty."""
    out = np.empty((len(first) - 1, len(_A)), dtype=np.uint32)
    room = np.empty_like(values)
    for i in range(len(_A)):
        np.multiply(values, _A[i], out=room)
        room += _B[i]
        out[:, i] = (np.minimum.reduceat(room, first[:-1]) >> np.uint64(32)).astype(np.uint32)
    return out


def _signed(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets with their bounds, which texts have any, and those texts' signatures."""
    values, first = shingle_sets(words, size)
    some = np.flatnonzero(np.diff(first))
    rows = np.empty((len(some), len(_A)), dtype=np.uint32)
    begin = np.append(first[some], len(values))
    # blocks that stay in the processor's cache
    for block in np.array_split(np.arange(len(some)), max(1, len(values) >> 15)):
        if len(block):
            lo, hi = begin[block[0]], begin[block[-1] + 1]
            rows[block] = _signatures(values[lo:hi], np.append(begin[block], hi) - lo)
    return values, first, some, rows


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in batches_of_words(batch.column("text"), WHITE, lower=True):
                values, first, some, rows = _signed(words, size)
                n = np.diff(first)
                marks = np.zeros((2, hi - lo), dtype=np.uint64)
                signatures: list[bytes | None] = [None] * (hi - lo)
                if len(some):
                    for k in (0, 1):
                        marks[k, some] = np.add.reduceat(mix64(values + np.uint64(k + 1)), first[some])
                    for j, row in zip(some, rows, strict=True):
                        signatures[j] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), int64(marks[0]), int64(marks[1]), pa.array(signatures, pa.binary())],
                    ["id", "n", "f1", "f2", "signature"],
                )

    return docs.mapInArrow(emit, "id long, n long, f1 long, f2 long, signature binary")


def _band_keys(rows: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    rows = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS)).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x100000001B3) + rows[:, :, i])
    return key


def _band_rows(sketches: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(len(batch), -1)
                ids, n = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("id", "n"))
                yield pa.RecordBatch.from_arrays([int64(_band_keys(rows).ravel()), pa.array(ids), pa.array(n)], ["band", "id", "n"])

    return sketches.select("id", "n", "signature").mapInArrow(emit, "band long, id long, n long")


_NIBBLES = 16
_PACKED = -(-BANDS * ROWS // _NIBBLES)


def _members(texts: DataFrame, size: int) -> DataFrame:
    """(id, packed, keys, grams, alike): four bits of each minimum, band keys, 32 bits of each shingle, and how many of these repeat others."""

    def lists(values: np.ndarray) -> pa.Array:
        flat = values.view(np.int64) if values.dtype == np.uint64 else values
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(flat.ravel()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in batches_of_words(batch.column("text"), WHITE, lower=True):
                values, first, some, rows = _signed(words, size)
                nibbles = np.zeros((len(some), _PACKED * _NIBBLES), dtype=np.uint64)
                nibbles[:, : rows.shape[1]] = rows & 0xF
                packed = (nibbles.reshape(len(some), _PACKED, _NIBBLES) << (np.arange(_NIBBLES, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
                short = values.astype(np.uint32).view(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(np.append(first[some], len(short)).astype(np.int32)), pa.array(short))
                n = np.diff(first)[some]
                key = np.unique((np.repeat(np.arange(len(some), dtype=np.uint64), n) << np.uint64(32)) | values.astype(np.uint32).astype(np.uint64))
                alike = n - np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(some))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo).take(pa.array(some)), lists(packed), lists(_band_keys(rows)), grams, pa.array(alike.astype(np.int32))], ["id", "packed", "keys", "grams", "alike"])

    return texts.mapInArrow(emit, "id long, packed array<long>, keys array<long>, grams array<int>, alike int")


def _across(placed: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that share a bucket and seem to reach the similarity.

    A bucket with many comparisons is cut into blocks of members by blocks of those outside its largest
    component, each a join key of its own, so that no task gets a hot bucket whole.
    """
    counts = placed.groupBy("band", "component").count().groupBy("band").agg(F.sum("count").alias("members"), F.max(F.struct("count", (-F.col("component")).alias("other"))).alias("most"))
    comparisons = F.col("members").cast("double") * (F.col("members") - F.col("most.count"))
    cut = scratch.keep(counts.select("band", (-F.col("most.other")).alias("main"), F.greatest(F.lit(1), F.ceil(F.sqrt(comparisons / _PAIRS))).cast("int").alias("cuts")), "cuts")
    rows = placed.join(cut, "band").join(members, "id")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    own = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), "cuts").cast("int")
    outside = rows.where("component <> main").select("band", F.explode(every).alias("x"), own(2).alias("y"), *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "component", "packed", "keys", "grams", "alike")])
    rows = rows.select("band", own(1).alias("x"), F.explode(every).alias("y"), "id", "n", "component", "packed", "keys", "grams", "alike")
    unlike = None
    for i in range(_PACKED):
        x = F.col("packed")[i].bitwiseXOR(F.col("o_packed")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
        unlike = x if unlike is None else unlike + x
    p = percent / 100
    p = p + (1 - p) / _NIBBLES
    most_unlike = BANDS * ROWS * (1 - p) + _SLACK * (BANDS * ROWS * p * (1 - p)) ** 0.5
    first = F.element_at(F.filter(F.zip_with("keys", "o_keys", lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull()), 1)
    # 32 bits may make different shingles alike; no more common ones are lost than either text's repeats, and the texts decide
    common = F.size(F.array_intersect("grams", "o_grams")) + F.least("alike", "o_alike")
    alike = 100 * common >= percent * (F.size("grams") + F.size("o_grams") - common)
    sizes = F.expr(f"100 * least(n, o_n) >= {percent} * greatest(n, o_n)")
    for c in ("band", "x", "y"):
        outside = outside.withColumnRenamed(c, f"o_{c}")
    same = (F.col("band") == F.col("o_band")) & (F.col("x") == F.col("o_x")) & (F.col("y") == F.col("o_y"))
    joined = rows.join(outside, same & (F.col("component") != F.col("o_component")) & sizes & (unlike <= most_unlike) & (first == F.col("band")) & alike)
    return joined.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow the similarity."""
    p = percent / 100
    least = (p - _SLACK * (p * (1 - p) / (BANDS * ROWS)) ** 0.5) * BANDS * ROWS

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    side = {c: sketches.select(F.col("id").alias(c), F.col("signature").alias(f"s{c}")) for c in ("a", "b")}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that reach the similarity on their full shingle sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            sides = []
            for c in ("ta", "tb"):
                sets: list[np.ndarray] = []
                for _, _, words in batches_of_words(batch.column(c), WHITE, lower=True):
                    values, first = shingle_sets(words, size)
                    sets += [values[first[i] : first[i + 1]] for i in range(words.texts)]
                sides.append(sets)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = len(both) > 0 and 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = {c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b")}
    joined = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "ta", "tb")
    return scratch.keep(joined.mapInArrow(test, "a long, b long"), "edges")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): a row for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut at white space; a document's set holds its distinct shingles of
    ``size`` words, or its whole sequence if it has fewer. Two documents are linked if
    ``100 * intersection >= percent * union``. ``component_id`` is the smallest id reachable by links,
    ``kept`` says that it is the document's own. Null or empty texts have no shingles and link with
    nothing; a text is read whole however long it is, in one worker at once; rows with one id are one
    document for links and each keep a row; a null id links with nothing, has a null ``component_id`` and is kept. Other columns of ``docs`` don't matter. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.keep(_sketches(docs, size), "sketches")
    named = sketches.where("id is not null and n > 0")
    classes = scratch.keep(named.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.keep(named.join(classes, ["f1", "f2"]).where("id = rep").dropDuplicates(["id", "f1", "f2"]).select("id", "n", "signature"), "reps")

    bands = _band_rows(reps)
    # xor with the band's key names a member by chance, and names it again
    centres = bands.groupBy("band").agg(F.count("*").alias("members"), F.min("id").alias("centre"), F.min(F.col("id").bitwiseXOR(F.col("band"))).alias("second"))
    centres = centres.where("members > 1").select("band", "centre", F.col("second").bitwiseXOR(F.col("band")).alias("second"))
    buckets = scratch.keep(bands.join(centres, "band"), "buckets")
    texts = scratch.keep(docs.join(buckets.select("id").distinct(), "id", "left_semi"), "texts")
    sizes = reps.select(F.col("id").alias("centre"), F.col("n").alias("m"))
    star = buckets.select(F.explode(F.array("centre", "second")).alias("centre"), "id", "n").where("id <> centre").distinct().join(sizes, "centre")
    star = star.where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    alike = scratch.keep(_alike(star, reps, percent), "alike")
    edges = _confirmed(alike, texts, size, percent, scratch)
    scratch.forget(alike)
    found = connected_components(edges, scratch)

    placed = buckets.join(found, buckets["id"] == found["node"], "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    placed = scratch.keep(placed.join(mixed, "band"), "mixed")
    members = scratch.keep(_members(texts.join(placed.select("id").distinct(), "id", "left_semi").select("id", "text"), size), "members")
    across = scratch.keep(_across(placed, members, percent, scratch), "across")
    scratch.forget(members, placed, buckets)
    more = _confirmed(across, texts, size, percent, scratch)
    scratch.forget(texts, across)
    if more.take(1):
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch)

    of = classes.join(found, classes["rep"] == found["node"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n", "f1", "f2").join(of, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
