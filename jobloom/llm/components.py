"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that ``edges`` name.

    Neighbourhoods are never gathered: each star step is a minimum per node, which combines before
    the shuffle, joined back to the edges, where adaptive execution can split a hub's partition.
    Edges with a null end and loops are dropped. An empty edge table gives an empty result.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    links, state = scratch.keep(links, "links"), None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m")).distinct()
        new = scratch.keep(small, "links")
        scratch.forget(links)
        links = new
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select("lo", "lo").distinct())
