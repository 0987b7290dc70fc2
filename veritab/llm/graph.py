"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is one node of its component.

    Nodes are ordered by a hash of themselves. Each round every node points to its least neighbour (or itself),
    then to what that one points to, and the edges are rewritten to what their ends point to. Nodes that nothing points to
    disappear, so the graph shrinks until no edge is left. As the order has nothing to do with the
    edges, a round leaves less than half of a long chain: rounds grow with the logarithm of the
    number of nodes, where an order along the chain would take a round a node. The
    least neighbour is a partial aggregate, so a hub costs no more than its edges, and
    each round's tables are written to the shared folder. An empty edge table gives
    an empty result; self-links, repeated links and nulls are dropped.
    """
    ordered = lambda c: F.struct(F.xxhash64(c).alias("hash"), c.alias("node"))
    ends = edges.where(F.col(a) != F.col(b)).select(ordered(F.col(a)).alias("u"), ordered(F.col(b)).alias("v"))
    edges = staged(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while roots is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        points = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("at"), F.least("u", "v").alias("to")), "least")
        further = points.select(F.col("at").alias("to"), F.col("to").alias("further"))
        points = staged(points.join(further, "to").select("at", F.col("further").alias("to")), "points")
        if roots is None:
            roots = points.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(points, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = staged(roots, "roots")
        edges = staged(_moved(edges, points), "edges")
    return roots.select(F.col("node.node").alias("node"), F.col("root.node").alias("root"))


def _moved(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The edges between what their ends point to."""
    to = lambda end, name: points.select(F.col("at").alias(end), F.col("to").alias(name))
    both: tuple[Column, Column] = (F.col("nu"), F.col("nv"))
    moved = edges.join(to("u", "nu"), "u").join(to("v", "nv"), "v").where(both[0] != both[1])
    return moved.select(F.least(*both).alias("u"), F.greatest(*both).alias("v")).distinct()
