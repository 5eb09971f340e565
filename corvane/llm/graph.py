"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, table


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node of (a, b) edges; root: the smallest node that it reaches.

    Alternating large and small stars (Kiveris et al. 2014): each round is two groupings and two equi-joins over the edges, and
    rounds grow with the logarithm of the longest chain. Each round's edges are written to the
    shared folder, in so many files at most, and those of the round before are deleted.
    """
    pairs = lambda df, *ends: df.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends])).alias("x")).select("x.*")
    edges = table(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), files)
    state = None
    while True:
        both = pairs(edges, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = pairs(large.join(low, "u"), ("v", "m"), ("u", "m"))
        before, edges = edges, table(small.where("u <> v").distinct(), files)
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # every remaining edge points at its component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
