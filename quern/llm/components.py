"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that it reaches.

    A round is a large star, then a small star. Each is a map-side combined minimum and an
    equi-join, so a hub's neighbours are never gathered; each round's edges are staged in the
    shared folder. Rounds grow with the logarithm of the longest chain. Self loops and nulls
    are ignored; an empty edge list gives no rows.
    """
    e = edges.select(F.col("u"), F.col("v")).where("u <> v")
    e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = staged(small.where("u <> v").distinct(), "edges")
        a, b = signature(e), signature(nxt)
        dropped(e)
        e = nxt
        if a == b:
            break
    return e.groupBy("u").agg(F.min("v").alias("r")).select(F.col("u").alias("node"), F.col("r").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def signature(e: DataFrame) -> tuple:
    """Number and order-free checksum of the edges; equal ones mean that a round changed nothing."""
    return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())
