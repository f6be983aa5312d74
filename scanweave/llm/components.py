"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (id, root): every id that has an edge, with the smallest id that it can reach.

    Alternating star contraction: first every node hangs its larger neighbours
    below its smallest one, then its smaller ones. The number of rounds grows
    with the logarithm of the size, the number of edges doesn't grow, and each
    round's edges are written to the shared folder, so a lost executor repeats
    one round at most. So are the smallest neighbours before edges are joined with
    them: a node with very many edges is then cut by adaptive execution. No edge or node list reaches the driver. Self-loops,
    repeated edges and edges with a null end count for nothing.
    """
    e = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(df: DataFrame, large: bool) -> DataFrame:
        """Hang each node's neighbours that are larger (or not larger) than itself below the smallest of its neighbourhood."""
        both = df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "smallest")
        hung = both.join(least, both["u"] == least["w"])
        if large:
            return hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = least.where(F.col("m") < F.col("w")).select(F.col("w").alias("u"), F.col("m").alias("v"))
        return hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()

    mark = None
    while True:
        e = materialise(star(star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now
