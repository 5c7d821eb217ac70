"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller ones and itself) are tied to the least of them."""
    a, b = F.greatest("u", "v"), F.least("u", "v")
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = edges.select(a.alias("u"), b.alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root for each node of edges (u, v): root is the least node of its component. rows: about how many nodes.

    Alternates the two star steps of large graphs until nothing changes; each result is written to the shared folder, and
    the one before it deleted.
    """
    with scratch():
        now, before = settle(edges.select("u", "v").where("u <> v").distinct(), rows), None
        while True:
            half = settle(_star(now, True), rows)
            new = settle(_star(half, False), rows)
            discard(half)
            discard(now)
            now = new
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
        return settle(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct()), rows, outer=True)
