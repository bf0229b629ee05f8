"""Connected components of a pair table by minimum-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for every id in pairs(a, b): root is the smallest id of its component.

    Each round takes the least label among neighbours and then the label's own label, so long
    chains shorten quickly. Every round is written to the shared folder. Repeated pairs, loops and
    pairs in either direction give the same result; an empty table gives an empty one.
    """
    edges = written(pairs.select("a", "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels.id == near.a, "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = labels.select(F.col("id").alias("via"), F.col("root").alias("beyond"))
        moved = moved.join(jump, moved.next == jump.via, "left").select("id", "root", F.least("next", F.coalesce("beyond", "next")).alias("next"))
        moved = written(moved, "labels")
        labels = moved.select("id", F.col("next").alias("root"))
        if moved.where("next != root").isEmpty():
            return labels
