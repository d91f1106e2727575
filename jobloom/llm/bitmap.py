"""A set of hashes as a map of bits of fixed size, for broadcasts that must not grow with the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch


class Bitmap:
    """Bit ``h >> (64 - bits)`` is set for each hash h. It may hold hashes that it wasn't given, and never lacks one."""

    def __init__(self, cells: np.ndarray, bits: int) -> None:
        self.cells, self.bits = cells, bits

    @classmethod
    def of(cls, rows: DataFrame, column: str, bits: int, scratch: Scratch) -> Bitmap:
        """Of a long column; cells of 64 bits are put together before they go to the driver, 2 ** (bits - 2) bytes at most."""
        place = F.shiftrightunsigned(column, 64 - bits)
        one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
        cells = scratch.keep(rows.where(F.col(column).isNotNull()).groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(one).alias("bits")), "cells")
        out = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in cells.toArrow().to_batches():
            out[batch.column("cell").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
        scratch.forget(cells)
        return cls(out, bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the map holds each of some unsigned hashes."""
        place = hashes >> np.uint64(64 - self.bits)
        return (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
