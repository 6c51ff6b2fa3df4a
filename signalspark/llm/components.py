"""Connected components of an edge table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import stored


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge, with the smallest node of its component.

    In every round each node joins the neighbour (or itself) that comes first in an order drawn anew, and the
    edges between what was joined are kept: their number falls by a constant share in expectation, so that a
    path as long as the data takes a logarithmic number of rounds. Minima and distinct edges are pre-aggregated
    in the tasks; no node's neighbours are gathered. Self-loops and repeated edges are harmless, an empty table
    gives an empty one.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    left = stored(edges.where("a is not null and b is not null").distinct(), "edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owner = stored(nodes.select("node", F.col("node").alias("root")), "owners")
    turn = 0
    while left.where("a <> b").limit(1).count():
        both = left.where("a <> b").select(F.explode(F.expr("array(struct(a, b), struct(b as a, a as b))")).alias("e"))
        order = F.struct(F.xxhash64("e.b", F.lit(turn)), "e.b")
        nearest = both.groupBy("e.a").agg(F.min(order).alias("best")).select(F.col("a").alias("old"), "best")
        own = F.struct(F.xxhash64("old", F.lit(turn)).alias("col1"), F.col("old").alias("b"))
        joined = stored(nearest.select("old", F.least(F.col("best"), own)["b"].alias("new")), "joins")
        moved = (
            left.join(joined.select(F.col("old").alias("a"), F.col("new").alias("new_a")), "a", "left")
            .join(joined.select(F.col("old").alias("b"), F.col("new").alias("new_b")), "b", "left")
            .select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"))
        )
        left = stored(moved.where("a <> b").distinct(), "edges")
        named = joined.select(F.col("old").alias("root"), "new")
        owner = stored(
            owner.join(named, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "owners"
        )
        turn += 1
    least = owner.groupBy("root").agg(F.min("node").alias("component"))
    return owner.join(least, "root").select("node", "component")
