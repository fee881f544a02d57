"""Connected components by contraction: every vertex hooks to its least neighbour, pointers are doubled, edges relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the least node of its component.

    Null ends and loops are ignored, repeated edges count once, no edges give an empty table. Each round at least halves
    the vertices of a component that still have edges; all tables are written, none is collected.
    """
    left = scratch.cut(_tidy(edges), "edges")
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "hook")
        while True:
            up = hook.select(F.col("node").alias("n"), F.col("to").alias("t"))
            jumped = hook.join(up, hook["to"] == up["n"], "left").select("node", F.coalesce("t", "to").alias("to"), (F.col("t") != F.col("to")).alias("moved"))
            jumped = scratch.cut(jumped, "jump")
            hook, moved = jumped.select("node", "to"), jumped.where("moved")
            if moved.isEmpty():
                break
        a, b = hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = scratch.cut(_tidy(left.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("node").alias("n"), F.col("to").alias("t"))
            found = scratch.cut(found.join(up, found["to"] == up["n"], "left").select("node", F.coalesce("t", "to").alias("to")), "found")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.withColumnRenamed("to", "component")
