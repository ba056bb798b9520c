"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each node's larger (or smaller) neighbours move to its smallest one, itself included.

    The smallest neighbour is found by a partial aggregate and joined back, so that the neighbours of a
    hub never meet in one place.
    """
    pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of edges(u, v) is linked with. Nodes without an edge have no row.

    Each round is written to the shared folder. Rounds end when nothing moves: after about the logarithm
    of the longest path.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    tally = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = tally(now)
    for _ in range(limit):
        if not before[0]:
            break
        now = stored(_stars(_stars(now, True), False), "edges")
        after = tally(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
