"""Connected components of a graph given as a table of edges, without collecting any of it.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every step is an
aggregation with map-side minimum followed by a join, so that a node with very many neighbours is pre-aggregated on the way up and its rows
can be split by the adaptive skew join on the way down.  Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (node, root): the smallest node each node can reach.

    Nodes without an edge are not in the result.  Self-loops, repeated edges and edges with a null end are ignored; no edge gives no row.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state != before:
        before, last = state, now
        now = saved(_small_star(_large_star(last)))
        state = _state(now)
        forget(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
