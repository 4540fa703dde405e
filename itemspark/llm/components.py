"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of distinct edges apart; nothing in it overflows."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for every node of an edge the smallest node it is connected with.

    Each round hangs the larger neighbours of every node on its smallest one, then the
    smaller ones, until every node hangs on its root; the number of rounds grows with
    the logarithm of the longest path.  Minima are taken before the shuffle, and the
    joins have no limit on a node's neighbours (Spark splits large ones).  Edges with
    a null end or of a node with itself are left out, so nodes without another edge
    don't appear.
    """
    edges = (edges.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).dropDuplicates())
    edges = cut_lineage(edges, "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .dropDuplicates())
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = (edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.toDF("a", "b")).dropDuplicates())
        edges = cut_lineage(edges, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).dropDuplicates())
