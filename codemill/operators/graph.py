"""Iterative graph operators as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemill.storage import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is connected with) of undirected edges src, dst.

    Alternating large-star and small-star contraction until nothing changes: each round rewires every node to the smallest one
    that it knows, so that a hub never has to list its neighbours in one task; what a node knows is the least of its
    neighbours, which is counted before the shuffle. Rounds grow with the logarithm of the longest path. Edges with a null end
    and loops are ignored; repeated edges count once; an empty table gives an empty result. Each round is written to the shared
    folder, which cuts the lineage."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null")
    e = staged(e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components")
    marks = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")
    mark = e.agg(*marks).first()
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node with its smaller neighbours
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("u"), "v").union(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
        e = staged(small.where("u <> v").distinct(), "components")
        now = e.agg(*marks).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u"), F.col("u"))).distinct()
