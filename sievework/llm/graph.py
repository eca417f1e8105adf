"""Connected components of an edge table, without moving the graph to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(v, c) for each vertex of the edges (a, b): c is the smallest vertex that v reaches.

    Labels shrink to the least among the neighbours, then to their label's label, until none changes. Each round is a
    written table, so a lost executor costs one round; the round before is deleted then. An edge table without rows gives no rows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), folder, f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("c")), folder, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        least = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        near = labels.join(least, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        labels = written(near.join(up, "c").select("v", F.col("cc").alias("c"), (F.col("cc") != F.col("old")).alias("changed")), folder, f"{name}-{turn}")
        discard(edges.sparkSession, f"{folder}/{name}-{turn - 1}")
        if labels.where("changed").isEmpty():
            discard(edges.sparkSession, f"{folder}/{name}-edges")
            return labels.select("v", "c")
        labels = labels.select("v", "c")
