"""Ranks and orders of the listing queries; every null placement is written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(value: Column, names: tuple[str, ...]) -> Column:
    """Position of the value among the names from 1, one more than their number for others."""
    out = F.lit(len(names) + 1)
    for i, name in reversed(list(enumerate(names, 1))):
        out = F.when(value == name, i).otherwise(out)
    return out


def interest_rank(value: Column) -> Column:
    """True, then unknown, then false."""
    return F.when(value, 1).when(value.isNull(), 2).otherwise(3)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order, with ``rn``, the row's place in the whole order.

    Only the rows up to the page's end are ranked: the limit keeps that many rows per partition before
    they meet, and the ranking sees no more than ``number * size`` rows.
    """
    if size <= 0 or number <= 0:
        return rows.withColumn("rn", F.lit(1).cast("long")).limit(0)
    first = (number - 1) * size
    top = rows.orderBy(*order).limit(first + size)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("rn") > first)
