"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import discard, stored


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) reaches.

    Alternating large-star and small-star contraction; each round is written to the shared
    folder, so its lineage stays short and nothing but two counts comes to the driver.
    A node with many neighbours is only ever aggregated with a map-side minimum and joined
    with a one-row side, which adaptive execution can split.
    Nulls and self-loops are ignored; an empty input gives an empty result.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), name="edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, name="edges")
        discard(now)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, large.u == least.k).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"), F.col("u").alias("w"), "m")
        now = small.select("u", "v").where("u <> v").union(small.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        now = stored(now, name="edges")
        discard(large)
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (seen.n, seen.h) == before:
            break
        before = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    return found.select(F.col("u").alias("node"), "component").union(found.select("component", "component").distinct())
