"""Helpers for the trained document filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .cluster import Scratch
from .words import Words, batches_of_words

#: The map of labelled ids has this many bits (16 MB) whatever the input.
MAP_BITS = 27


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether a row is kept from training; a row with a null id is."""
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(True))


def labelled_rows(docs: DataFrame, read: Callable[[Words], list[bytes]], separator: np.ndarray, lower: bool, labels: DataFrame, target: str, id_col: str, modulus: int, rest: int) -> DataFrame:
    """(id, features, label) of the documents whose label may be learnt from, a row for each different label.

    ``read`` turns texts into features before the join, so that no text is shuffled. Labels grow with the
    corpus and are never broadcast; a map of bits of their ids, of fixed size, spares texts without a label
    the reading and the shuffle, and the join decides.
    """
    scratch = Scratch(docs.sparkSession)
    learnt = ~held_out(id_col, modulus, rest)
    chosen = labels.where(F.col(target).isin(0, 1) & learnt).select(F.col(id_col).cast("long").alias("id"), F.col(target).cast("int").alias("label")).distinct()
    known = docs.sparkSession.sparkContext.broadcast(Bitmap.of(chosen.select(F.xxhash64("id").alias("mark")), "mark", MAP_BITS, scratch))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(known.value.holds(batch.column("mark").to_numpy().view(np.uint64))))
            for lo, hi, words in batches_of_words(batch.column("text"), separator, lower):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(read(words), pa.binary())], ["id", "features"])

    id_ = F.col(id_col).cast("long")
    texts = docs.where(learnt).select(id_.alias("id"), F.xxhash64(id_).alias("mark"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(emit, "id long, features binary").join(chosen.hint("merge"), "id")
