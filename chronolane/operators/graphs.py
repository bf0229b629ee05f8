"""Dependency graphs whose nodes may have many parents: order, levels, cycles, and edges that break the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .timing import ladder


def edge_states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent, state) of edges(node, parent): PARENT_MISSING if no node has that name, FORWARD_REFERENCE if its position is not before the node's, else OK.

    nodes(node, position). Edges of nodes that are not listed are left out; repeated edges stay repeated.
    """
    at = edges.select("node", "parent").join(nodes.select("node", F.col("position").alias("_here")), "node")
    at = at.join(nodes.select(F.col("node").alias("parent"), F.col("position").alias("_there")), "parent", "left")
    return at.select("node", "parent", ladder((F.col("_there").isNull(), "PARENT_MISSING"), (F.col("_there") >= F.col("_here"), "FORWARD_REFERENCE"), otherwise="OK").alias("state"))


def _ends(singles: DataFrame) -> DataFrame:
    """singles(node, up, w, b), each with one parent, by pointer jumping: up is the first ancestor that is no single, and w and b are those of the whole way; `endless` if it never meets such an ancestor. Written.

    A way stands for level -> max(b, level + w), and two of them in a row for one of the same kind.
    """
    at = written(singles.select("node", "up", "w", "b"), "singles")
    names = at.select(F.col("node").alias("single"))
    at = written(at.join(names, F.col("up") == F.col("single"), "left").select("node", "up", "w", "b", F.col("single").isNotNull().alias("open")), "singles")
    ended, moving = at.where("not open"), at.where("open")
    left, before = moving.count(), None
    # a round in which no way ends: each that is open leads to another open one, and so for ever
    while left and left != before:
        via = moving.unionByName(ended).select(F.col("node").alias("_via"), F.col("up").alias("_up"), F.col("w").alias("_w"), F.col("b").alias("_b"), F.col("open").alias("_open"))
        moved = moving.join(via, F.col("up") == F.col("_via"))
        moved = moved.select("node", F.col("_up").alias("up"), (F.col("w") + F.col("_w")).alias("w"), F.greatest(F.col("b"), F.col("w") + F.col("_b")).alias("b"), F.col("_open").alias("open"))
        moved = written(moved, "singles")
        ended, moving = ended.unionByName(moved.where("not open")), moved.where("open")
        left, before = moving.count(), left
    return ended.unionByName(moving).withColumnRenamed("open", "endless")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of nodes(node) under edges(node, parent): 0 without parents, else one more than the highest of them; null for a node on a cycle or behind one.

    Nodes whose parents all have levels get theirs and leave the graph. Between such rounds, ways through nodes
    with a single parent are contracted by pointer jumping, and edges that then coincide become one, so chains
    and chains of diamonds take a logarithm of their length in rounds; other graphs take at most as many
    rounds as they have levels. Every round is written. Edges to or from unlisted nodes are ignored,
    repeated nodes and edges count once.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    left = written(nodes.select("node").where("node is not null").distinct().withColumn("b", F.lit(0).cast("long")), "nodes")
    names = left.select("node")
    ways = edges.select("node", "parent").distinct().join(names, "node").join(names.select(F.col("node").alias("parent")), "parent").withColumn("w", F.lit(1).cast("long"))
    ways, found = written(ways.select("node", "parent", "w"), "ways"), None
    while True:
        degree = ways.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("up"), F.min("w").alias("w"))
        at = written(left.join(degree, "node", "left"), "degrees")
        done = at.where("n is null").select("node", F.col("b").alias("level"))
        found = done if found is None else found.unionByName(done)
        ends = _ends(at.where("n = 1").select("node", "up", "w", "b"))
        singles, endless = ends.where("not endless"), ends.where("endless").select("node")
        # what an edge's parent stands for now: its level, the end of its way, or itself
        known = done.select(F.col("node").alias("parent"), "level", F.lit(None).cast(kind).alias("up"), F.lit(None).cast("long").alias("_w"))
        ended = singles.join(done.select(F.col("node").alias("up"), F.col("level").alias("_top")), "up", "left")
        open_end = lambda c: F.when(F.col("_top").isNull(), F.col(c))  # noqa: E731  where a way ends in a node that is done, its level is known too
        known = known.unionByName(ended.select(F.col("node").alias("parent"), F.greatest("b", F.col("_top") + F.col("w")).alias("level"), open_end("up").alias("up"), open_end("w").alias("_w")))
        told = written(ways.join(known.withColumn("_told", F.lit(True)), "parent", "left"), "told")
        if told.where("_told").isEmpty():
            return names.join(found, "node", "left")
        base = told.where("_told").groupBy("node").agg(F.max(F.col("w") + F.col("level")).alias("_b"))
        # an endless way is a cycle, or leads to one: its nodes have no level, and nothing behind them has
        left = at.where("n is not null").join(endless, "node", "left_anti").join(base, "node", "left").select("node", F.greatest("b", F.coalesce("_b", "b")).alias("b"))
        ways = told.where("_told is null or up is not null").join(endless, "node", "left_anti").select("node", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        left, ways = written(left, "nodes"), written(ways.groupBy("node", "parent").agg(F.max("w").alias("w")), "ways")
