"""Connected components of a table of links, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label for every node of links(a, b): label is the smallest node that can be reached from it.

    Alternating large-star and small-star steps: each replaces links by links to a node's least neighbour, until nothing changes,
    which takes a number of rounds that grows with the logarithm of the longest path. A hub's links meet its least neighbour in
    a join of two tables, whose skew adaptive execution splits, never in one group.
    """
    scratch.write(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), f"{name}-0")
    schema, step, before = "u bigint, v bigint", 0, None
    while True:
        held = scratch.read(f"{name}-{step}", schema)
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = held.union(held.selectExpr("v", "u"))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        half = scratch.write(large, f"{name}-half")
        least = scratch.write(half.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least2")
        small = half.join(least, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").where("u <> v").distinct()
        scratch.write(small, f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", f"{name}-least", f"{name}-half", f"{name}-least2")
        step += 1
    # every node now links to its component's least node only
    held = scratch.read(f"{name}-{step}", schema)
    return scratch.write(held.selectExpr("u AS node", "v AS label").union(held.selectExpr("v", "v").distinct()), f"{name}-labels")
