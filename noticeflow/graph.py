"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.scratch import Scratch, spread_join


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (src > dst)."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
    large = spread_join(both, low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
    least = large.groupBy("src").agg(F.min("dst").alias("low"))
    small = spread_join(large, least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return small.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first())


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    `edges` has two columns of one orderable type.  Self loops, repeats, either
    direction and nulls are allowed (an edge with a null end is no edge); no
    edges give an empty table.  Each round is written to the shared folder.
    A node of any degree is spread: minima are pre-aggregated and the joins can
    be split by AQE.
    """
    a, b = edges.columns
    now = scratch.save(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct(), f"{label}-0"
    )
    state, turn = _digest(now), 0
    while state[0]:
        turn += 1
        after = scratch.save(_stars(now), f"{label}-{turn}")
        new = _digest(after)
        scratch.drop(f"{label}-{turn - 1}")
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
