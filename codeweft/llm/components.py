"""Connected components of an edge list by alternating large and small stars.

Each round hangs every node's larger neighbours on its least neighbour, then every node's smaller
neighbours on the least of those. Rounds are aggregations and equi-joins of narrow rows; a hub is
split by adaptive execution. A round's edges are written to the shared folder, so lineage stays
short. Rounds end when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import discard, materialize

MOST_ROUNDS = 64


def _star(edges: DataFrame) -> DataFrame:
    """One round over (big, small) rows with big > small."""
    both = edges.unionByName(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))
    least = both.groupBy("big").agg(F.min("small").alias("m")).select("big", F.least("big", "m").alias("m"))
    up = both.where("small > big").join(least, "big").select(F.col("small").alias("big"), F.col("m").alias("small"))
    up = up.where("big > small").distinct()
    least = up.groupBy("big").agg(F.min("small").alias("m"))
    down = up.join(least, "big").where("small > m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return down.unionByName(least.select("big", F.col("m").alias("small"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of edges(big, small): root is the least node it is linked to."""
    spark = edges.sparkSession
    edges = materialize(edges.where("big > small").select("big", "small").distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        after = materialize(_star(edges), "edges")
        discard(spark, edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return edges.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)
