"""Connected components of an undirected edge table, by alternating large and small stars.

Every round is a grouped minimum and a join on the node, written to the shared folder; nothing is collected and
no adjacency list is built, so a node may have any number of edges. Rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.runtime import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component): the component is its smallest node. Edges with a null end and self-loops are ignored.

    Nodes without an edge don't appear; an empty table gives no rows; repeated edges count once.
    """
    cur = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(cur)
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        cur = materialize(small, "edges")
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets (up to a 64-bit hash)."""
    r = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return (r[0], r[1])
