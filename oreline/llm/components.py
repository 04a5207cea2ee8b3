"""Connected components of a graph far larger than the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oreline.operators.absent import join_afresh
from oreline.sources.paths import stored


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, label`` for every node of an undirected graph; the label is the component's
    smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Each step is a
    minimum per node, combined in the map tasks, joined back to the edges by fresh shuffles,
    which can be split; a hub's edges are never gathered.  A step's edges are written to the shared scratch folder, and only their
    count and a checksum reach the driver.  Self-loops and nulls are ignored.
    """
    u, v = F.col(left), F.col(right)
    graph = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    graph = stored(graph.distinct(), "edges")
    state = _state(graph)
    while state[0]:
        both = graph.union(graph.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = join_afresh(both, least, ["u"], "inner", step=4).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_afresh(large, least, ["u"], "inner", step=5).where(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        graph = stored(small.distinct(), "edges")
        before, state = state, _state(graph)
        if before == state:
            break
    members = graph.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = graph.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return members.union(roots)


def _state(graph: DataFrame) -> tuple:
    return tuple(graph.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
