"""Connected components of a graph of links, by contraction in a random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b): the least node that it is linked with.

    Each round orders the nodes by a hash of their own, lets every node go over
    to the first of itself and its neighbours, and keeps the edges between
    different ones of these. The last node in order is never chosen, so each
    round has fewer nodes and the loop ends; on average a fixed share of them
    goes, whatever the ids, so the rounds grow with the logarithm of the nodes.
    Nodes may be of any type with an order. Tables are written to shared storage
    between rounds and get smaller; rows follow the number of edges and nodes,
    never of pairs.
    """
    edges = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("at"), F.col(c).alias("node"))
        first = edges.groupBy("a").agg(F.min(order("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", order("a"))["node"].alias("to"))
        first = stored(first, "steps")
        steps.append(first)
        for side, other in (("a", "b"), ("b", "a")):
            edges = edges.join(first.withColumnsRenamed({"node": side}), side).select(F.col("to").alias(side), other)
        edges = stored(edges.where("a <> b").distinct(), "edges")
    roots = steps.pop()
    while steps:
        after = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = stored(steps.pop().join(after, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "roots")
    least = roots.groupBy("to").agg(F.min("node").alias("label"))
    return roots.join(least, "to").select("node", "label")
