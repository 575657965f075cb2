"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations with partial minima and two equi-joins.  A node with very many links doesn't meet them
in one task: such nodes are few, and their minima are broadcast (`keyed_join`).  Nothing is
collected.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, keyed_join


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """edges (a > b).  Large: link every larger neighbour of a node to its least neighbour.
    Small: link a node's smaller neighbours, and itself, to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("links"))
    else:
        both = edges
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
    least = scratch.keep(least, f"{name}-least")
    out = keyed_join(both, least, ["a"], "links", both.count())
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return scratch.keep(out.where("a > b").distinct(), name)


def components(spark: SparkSession, links: DataFrame, a: str, b: str) -> tuple[DataFrame, Scratch]:
    """(node, component) for every node that occurs in a link; component is the least node reachable.

    Self links and nulls are ignored; repeated links count once; no links give an empty table.
    The Scratch holds the returned table.
    """
    scratch = Scratch(spark)
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = scratch.keep(edges, "edges-0")
    before, i = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        i += 1
        edges = _star(_star(edges, True, scratch, f"large-{i}"), False, scratch, f"edges-{i}")
        scratch.drop(f"edges-{i - 1}", f"large-{i}", f"large-{i}-least", f"edges-{i}-least")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots), scratch
