"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _hang(e: DataFrame) -> bool:
    """Whether every node of the edges (a, b) is a centre or hangs on one centre alone."""
    roles = e.select(F.col("a").alias("node"), F.lit(0).alias("hangs")).union(e.select("b", F.lit(1)))
    nodes = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("n"))
    return nodes.where("hangs > 0 and n > 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) for every end of an edge; the component is its smallest node.

    Each round hangs a node's larger neighbours on its smallest one (large star), then its smaller ones (small star), until all edges
    are stars, in about log(n) rounds; edges that are stars to begin with take none. Minima are pre-aggregated before they are shuffled, and neighbours meet them in a plain
    equi-join, whose hot nodes adaptive execution splits. Every round ends in a table in the shared folder; only the
    number of nodes that do not hang on one centre reaches the driver. Loops and repeated edges do no harm; edges with a null end are left out.
    The result reads a table of its own, for the caller to :func:`discard`.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a < b").distinct()
    e = saved(e, name)
    while not _hang(e):
        old = e
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        # minima are tables of their own: both sides of each join are then shuffled for it alone, and its hot partitions can be split
        low = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), name)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select("u", "m"))
        e = saved(small.toDF("b", "a").where("a <> b").select("a", "b").distinct(), name)
        discard(old, low, large, least)
    out = e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", "a").distinct())
    out._saved_at = e._saved_at
    return out
