"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations and two joins over the edges; a round's edges are
a written table, so lineage stays short.  A node with very many neighbours is
reduced by partial minima before the shuffle, and its edges are rows that a
skewed join can split.  The number of rounds grows with the logarithm of the
longest chain.  No node, edge or component passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Stage


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """(id, component) of every node in (src, dst); component is the smallest id that links reach."""
    e = stage.keep(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), f"{name}-0")
    before, k = _fingerprint(e), 0
    while before[0]:
        k += 1
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m"))
        e = stage.keep(small.distinct(), f"{name}-{k}")
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
