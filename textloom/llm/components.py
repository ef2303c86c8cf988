"""Connected components of links between 64-bit values, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each value of ``links`` (a, b), root being the smallest value that is reachable; roots themselves are left out.

    Each round is written in the shared folder. A star's centre may have any number of leaves: minima are aggregated before the
    shuffle, and the join that follows is one that adaptive execution can split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = ws.save(edges, "edges-0"), None
    for k in range(1, rounds + 1):
        # large star: neighbours above a node move to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node itself, move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = ws.save(small.where("a <> b").distinct(), f"edges-{k}")
        ws.drop(f"edges-{k - 1}")
        # decimals do not overflow where sums of hashes do
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)
    raise RuntimeError("components did not settle")
