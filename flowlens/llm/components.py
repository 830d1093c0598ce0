"""Connected components of a link table by alternating large-star and small-star steps.

Each step re-links a node's neighbours to their smallest member, so the links become stars around the smallest id
of each component in a number of rounds that grows with the logarithm of the longest path. Both steps are a grouped
minimum (combined before the shuffle) and an equi join whose skewed keys the adaptive planner splits. Every round is
written as a table, so no lineage is carried and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(src long, dst long) links to (node, component): the smallest id reachable. Nodes without links to another
    node are left out; direction, repeats and self links do not matter; nulls are ignored."""
    ends = links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now = materialize(ends.distinct(), "links")
    state = _state(now)
    if state[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l"))
        now = materialize(small.select("l.u", "l.v").where("u <> v").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres)
