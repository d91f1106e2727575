"""Near-duplicate vectors: iterative quantisation codes in multi-index Hamming tables, reranked by cosine.

Vectors are compared within a group: one label and one length.

1. Equal directions of one group collapse to the vector with the smallest id and a multiplicity.
2. Rotations are learnt by iterative quantisation on a bounded sample (about ``SAMPLE`` vectors, chosen by
   a hash of their ids) for each length in it: principal directions, then turns that bring the signs
   nearest to the projections. The first takes the sample's medians as thresholds, so each bit is balanced;
   the others turn about the origin, where the chance of a differing bit follows from the angle. A length
   that the sample lacks, so a rare one, takes a turn by chance.
3. Each rotation gives a vector 64 bits, cut into tables of keys. Stored keys are the substrings; a probe
   asks for all keys within one bit of its own. The width of a key follows the largest group (its binary
   logarithm, 16 at least), so that a bucket's size doesn't grow with the input, and the number of tables,
   hence of rotations, is what a pair at the threshold needs to meet with the chance ``RECALL``.
4. A pair is taken from the first table in which it meets, and only if its codes are near enough; the
   cosine of the original vectors in double precision decides. Confirmed pairs are not written: each batch
   of them becomes one row a vector, with its number of links and the smallest vector reachable in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch
from .components import connected_components

SAMPLE = 8192
RECALL = 0.985
BITS = 64
LEAST_WIDTH = 16
_TURNS = 40
_HASH = 1 << 30


@dataclass(frozen=True)
class Plan:
    """``tables`` keys of ``width`` bits, so many to a rotation's 64 bits."""

    width: int
    tables: int

    @classmethod
    def of(cls, largest: int, cosine: float) -> Plan:
        width = min(max(LEAST_WIDTH, largest.bit_length()), BITS // 2)
        same = 1 - differing(cosine)
        meet = same**width + width * (1 - same) * same ** (width - 1)
        return cls(width, max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet)))) if meet < 1 else 1)

    @property
    def per_rotation(self) -> int:
        return BITS // self.width

    @property
    def rotations(self) -> int:
        return -(-self.tables // self.per_rotation)

    def place(self, table: int) -> tuple[int, int]:
        """Rotation and shift of a table's key."""
        return table // self.per_rotation, self.width * (table % self.per_rotation)


def differing(cosine: float) -> float:
    """Share of bits about the origin in which two vectors differ."""
    return float(np.arccos(min(1.0, max(-1.0, cosine))) / np.pi)


def learn(sample: np.ndarray, seed: int, centre: bool) -> tuple[np.ndarray, np.ndarray]:
    """Projection to 64 directions and their thresholds: medians of centred data, else the origin.

    Bits about the origin depend on angles alone, so they hold for samples of any size and shape.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    bits, d = BITS, sample.shape[1]
    centred = sample - sample.mean(axis=0) if centre and len(sample) else sample
    _, directions = np.linalg.eigh(centred.T @ centred)
    main = directions[:, ::-1][:, : min(bits, d)]
    if d < bits:  # fewer dimensions than bits: random directions among them
        main = main @ rng.normal(size=(main.shape[1], bits))
    projected = centred @ main
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(_TURNS):
        u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    project = main @ turn
    return project, np.median(sample @ project, axis=0) if centre and len(sample) else np.zeros(bits)


def _pack(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        values = column.take(pa.array(rows)) if len(rows) < len(sizes) else column
        yield rows, values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the finite vectors that aren't zero; components are scaled by the largest before."""
    for batch in batches:
        for rows, x in _by_length(batch.column("vector")) if len(batch) else ():
            largest = np.abs(x).max(axis=1)  # NaN for a null or NaN component
            some = np.flatnonzero((largest > 0) & (largest < np.inf))
            x = x[some] / largest[some, None]
            x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0  # -0.0 and 0.0 are one value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            given = [batch.column(c).take(pa.array(rows[some])) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*given, lists], ["id", "label", "vector"])


def _coded(rows: DataFrame, total: int, plan: Plan) -> DataFrame:
    """(id, label, size, vector, codes): unit vectors with a code of each rotation."""
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(_HASH)) < int(min(1.0, SAMPLE / max(total, 1)) * _HASH))
    sample = chosen.select("id", "vector").toArrow().sort_by("id").column("vector").combine_chunks()
    models = {x.shape[1]: [learn(x, seed, centre=seed == 0) for seed in range(plan.rotations)] for _, x in _by_length(sample)} if len(sample) else {}
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((len(batch), plan.rotations), dtype=np.uint64)
            for at, x in _by_length(batch.column("vector")) if len(batch) else ():
                model = shared.value.get(x.shape[1]) or [learn(x[:0], seed, centre=False) for seed in range(plan.rotations)]
                for k, (project, threshold) in enumerate(model):
                    codes[at, k] = _pack(x @ project > threshold)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * plan.rotations), pa.array(codes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "size", "vector")), lists], ["id", "label", "size", "vector", "codes"])

    return rows.mapInArrow(emit, "id long, label long, size long, vector array<double>, codes array<long>")


def _near_rows(coded: DataFrame, cosine: float, plan: Plan, scratch: Scratch) -> DataFrame:
    """(id, more, least): partial numbers of links, and links enough to connect what is connected."""
    mask = F.lit((1 << plan.width) - 1)
    places = [plan.place(t) for t in range(plan.tables)]
    part = lambda codes, place: F.shiftrightunsigned(codes[place[0]], place[1]).bitwiseAND(mask)
    keys = F.posexplode(F.array(*[part(F.col("codes"), p) for p in places])).alias("t", "key")
    stored = coded.select("id", "label", F.size("vector").alias("d"), "codes", keys)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(plan.width)])
    probes = stored.select(F.col("id").alias("q"), "label", "d", F.col("codes").alias("other"), "t", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"))
    # a pair is met in table t if its substrings differ in one bit at most; only the first such table counts
    first = F.lit(plan.tables)
    for t in reversed(range(plan.tables)):
        apart = F.bit_count(part(F.col("codes"), places[t]).bitwiseXOR(part(F.col("other"), places[t])))
        first = F.when(apart <= 1, t).otherwise(first)
    # 64 bits differ in 64 * angle / pi places on average; six standard deviations are allowed for
    share = differing(cosine)
    most = int(np.ceil(BITS * share + 6 * (BITS * share * (1 - share)) ** 0.5))
    near = F.least(*[F.bit_count(F.col("codes")[k].bitwiseXOR(F.col("other")[k])) for k in range(plan.rotations)], F.lit(BITS)) <= most
    pairs = probes.join(stored, ["label", "d", "t", "key"]).where((F.col("q") < F.col("id")) & (first == F.col("t")) & near).select(F.col("q").alias("a"), F.col("id").alias("b"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                same = np.empty(len(batch))
                for (at, x), (_, y) in zip(_by_length(batch.column("va")), _by_length(batch.column("vb")), strict=True):
                    same[at] = np.einsum("ij,ij->i", x, y)
                found = np.flatnonzero(same >= cosine)
                a, b, size_a, size_b = (batch.column(c).to_numpy()[found] for c in ("a", "b", "sa", "sb"))
                ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                more = np.bincount(at, np.concatenate([size_b, size_a]), len(ids)).astype(np.int64)
                least = ids[_smallest(at[: len(a)], at[len(a) :], len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(more), pa.array(least)], ["id", "more", "least"])

    side = {c: coded.select(F.col("id").alias(c), "label", F.col("size").alias(f"s{c}"), F.col("vector").alias(f"v{c}")) for c in ("a", "b")}
    joined = pairs.join(side["a"].drop("label"), "a").join(side["b"].drop("label"), "b").select("a", "b", "sa", "sb", "va", "vb")
    return scratch.keep(joined.mapInArrow(rerank, "id long, more long, least long"), "near")


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the links."""
    own = np.arange(n)
    while True:
        low = np.minimum(own[a], own[b])
        new = own.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == own).all():
            return own
        own = new


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): a row for each row of ``vectors``.

    Vectors of one label, which must not be null, and of one length are linked if their cosine in double
    precision reaches ``cosine``, equality included. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable by links, ``kept`` says that it is the vector's own. Null,
    empty and zero vectors and those with null or non-finite components link with nothing, whatever their
    length; components are scaled by the largest, so no finite vector is too long or too short. A row with
    a null id links with nothing and has a null ``component_id``; repeated ids are one vector if equal, and
    else compared each by itself, the id taking the most links and the smallest component of them.
    Other columns don't matter. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and size(vector) > 0")
    fine = scratch.keep(rows.mapInArrow(_directions, "id long, label long, vector array<double>").distinct(), "vectors")
    classes = scratch.keep(fine.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = classes.groupBy("label", F.size("vector")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    plan = Plan.of(groups[1], cosine)
    coded = scratch.keep(_coded(classes.select(F.col("node").alias("id"), "label", "size", "vector"), groups[0], plan), "codes")
    near = _near_rows(coded, cosine, plan, scratch)
    scratch.forget(coded)

    degree = near.groupBy(F.col("id").alias("node")).agg(F.sum("more").alias("more"))
    found = connected_components(near.select(F.col("id").alias("a"), F.col("least").alias("b")), scratch)
    named = classes.select("node", "rep").join(found, "node")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("smallest")), "component").select("node", "smallest")
    of = classes.join(degree, "node", "left").join(named, "node", "left")
    of = of.select("label", "vector", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("smallest", "rep").alias("component"))
    placed = scratch.keep(fine.join(of, ["label", "vector"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component")), "placed")
    scratch.forget(fine, classes, near)
    every = vectors.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("own"))
    out = every.join(placed, every["own"] == placed["id"], "left")
    component = F.coalesce("component", "own")
    return out.select(every["id"].alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("own"), F.lit(True)).alias("kept"))
