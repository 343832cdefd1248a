"""Connected components on DataFrames, and where intermediate tables are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import durable, remove, shared_folder

__all__ = ["components", "durable", "remove", "shared_folder"]


def _one_parent(edges: DataFrame) -> DataFrame:
    """Each child keeps its smallest parent, and hands its other parents on to that one.

    Parents are gathered as sets, which tasks fill before the shuffle; a child has few
    distinct ones, however many edges name them.
    """
    held = edges.groupBy("child").agg(F.collect_set("parent").alias("parents"), F.max("moved").alias("moved"))
    least = F.array_min("parents")
    own = F.struct("child", least.alias("parent"), (F.col("moved") | (F.size("parents") > 1)).alias("moved"))
    rest = F.transform(F.filter("parents", lambda p: p != least), lambda p: F.struct(p.alias("child"), least.alias("parent"), F.lit(True).alias("moved")))
    return held.select(F.explode(F.concat(F.array(own), rest)).alias("e")).select("e.*")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its smallest node.

    Edges point from the larger node (child) to the smaller (parent).  A round lets each
    edge point to its parent's smallest parent, then leaves each child its smallest
    parent; depth about halves.  Rounds end when nothing moves: every child then has one
    parent, which is no child, so it is its component's minimum.

    A hub's children lie in one join key, and that join has a plain shuffle on either
    side (the key is the parent's complement, by which nothing is dealt yet), which
    adaptive execution splits where a key is large.  Self edges and repeated edges are
    allowed; an empty edge list gives an empty result; edges with a null end are ignored.
    """
    first = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"), F.lit(False).alias("moved"))
    now = durable(_one_parent(first))
    for _ in range(most_rounds):
        above = now.groupBy("child").agg(F.min("parent").alias("above")).select(F.bitwise_not("child").alias("key"), "above")
        raised = now.select("child", "parent", F.bitwise_not("parent").alias("up")).join(above, F.col("up") == F.col("key"), "left")
        now = durable(_one_parent(raised.select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))))
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(now.select(F.col("parent"), F.col("parent")).distinct())
