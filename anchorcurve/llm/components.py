"""Connected components of a distributed edge table by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node of its component.

    A round points each node at its least neighbour, jumps pointers twice and contracts; the edges that are left
    and the labels are tables in the shared folder, never on the driver.  A hub costs one row for each edge: the
    least neighbour is a partial aggregate, and joins on a hub's name are ones that Spark may split.
    """
    e = C.cut(edges.selectExpr("cast(a as long) a", "cast(b as long) b").where("a != b").distinct(), "edges")
    labels = C.cut(e.selectExpr("a node").union(e.selectExpr("b node")).distinct().selectExpr("node", "node root"), "labels")
    for _ in range(most_rounds):
        if e.isEmpty():
            C.discard(e)
            return labels
        both = e.union(e.selectExpr("b a", "a b"))
        p = C.cut(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a u", "least(a, m) p"), "pointers")
        q = p
        for _ in range(2):
            q = q.alias("x").join(q.alias("y"), F.col("x.p") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p").alias("p"))
        q = C.cut(q, "jumped")
        left, right = q.selectExpr("u a", "p pa"), q.selectExpr("u b", "p pb")
        fewer = e.join(left, "a").join(right, "b").selectExpr("pa a", "pb b").where("a != b").distinct()
        fewer = C.cut(fewer, "edges")
        moved = labels.join(q.selectExpr("u root", "p"), "root", "left").selectExpr("node", "coalesce(p, root) root")
        moved = C.cut(moved, "labels")
        for old in (e, labels, p, q):
            C.discard(old)
        e, labels = fewer, moved
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
