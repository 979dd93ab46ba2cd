"""Connected components of an edge table by alternating large and small stars; labels are smallest node ids.

Each round is two grouped minima and two joins over the edges, written to the shared folder; nothing but a count and a
checksum reaches the driver. Star hubs are grouped with partial aggregates, and joins on them are ordinary shuffled
joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root for every node of an edge; root is the smallest node it reaches. Rounds go on until
    the edges stay as they are; each brings nodes nearer to their root, so they end."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small, "edges")
        forget(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
