"""Connected components of an edge table by alternating large-star and small-star steps.

No vertex's neighbours are ever gathered: each step is a minimum per vertex and an equi-join, and every step's
edges are a table in the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialize, release


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every vertex of ``edges`` (a, b), roots included; the root is a component's smallest vertex.

    Loops, repeated edges and edges with a null end are allowed and count for nothing.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(ordered, name)
    while not _settled(now):  # the number of steps grows with the logarithm of the component's size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are tables of their own: then the join has two plain sides, and a vertex of very many edges can be dealt to several tasks.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        joined = large.join(lower, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), name)
        release(now, least, large, lower)
        now = new
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
