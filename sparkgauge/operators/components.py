"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkgauge.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that is not its component's smallest; the component is that smallest node.

    Large-star and small-star steps alternate until nothing changes: each links nodes to the smallest
    neighbour they know, so a component becomes a star in a logarithmic number of rounds, whatever its
    shape, and no group is ever gathered in one row.  Every round is cut by a reliable checkpoint.  Rows with a null
    end and self links are ignored; repeated links count once; no links give no rows.
    """
    now = cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u itself hangs on m through the row of m, where it is a larger neighbour, or through the small star
        large = large.union(now).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.union(low.select("u", "m")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
