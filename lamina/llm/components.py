"""Connected components of an edge table, by alternating star contraction.

Every round replaces the edges by edges towards the smallest known neighbour (Kiveris et al.,
"Connected Components in MapReduce and Beyond"). The number of rounds grows with the logarithm of
the diameter. A round is an aggregation and an equi join; nothing is gathered on the driver but one
checksum row, and each round is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import durable

#: Into how many parts the pairs of a node are dealt when they meet its smallest neighbour.
SALTS = 8


def _towards_smallest(pairs: DataFrame) -> DataFrame:
    """``(u, v, m)``: every pair with the smallest of u and all v of u.

    The middle of a large star is a node with very many pairs: they meet its one row in ``SALTS`` tasks.
    """
    smallest = pairs.groupBy("u").agg(F.min("v").alias("s"))
    copies = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["u", "salt"]).select("u", "v", F.least("u", "s").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _towards_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    starred = _towards_smallest(edges)
    return (
        starred.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                         F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.*").where("u <> v").distinct()
    )


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable. Nodes are longs. Loops, repeated edges and either
    direction are allowed; edges with a null end are ignored. No edges: no rows.
    """
    current = durable(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    known = _checksum(current)
    while known[0]:
        current = durable(_small_star(_large_star(current)))
        found = _checksum(current)
        if found == known:
            break
        known = found
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
