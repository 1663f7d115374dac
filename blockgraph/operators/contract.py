"""Contraction of communities to vertices, and what follows it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from . import partition


@dataclass
class Contracted:
    graph: Graph
    #: (v, coarse)
    coarse_of: DataFrame


def aggregate_graph(g: Graph, refined: DataFrame, check: bool = True) -> Contracted:
    """Refined communities as vertices 0, 1, ... in id order: sizes and edge weights summed, inner edges as a self-loop.

    :raises ValueError: if check is set and refined isn't an assignment of all vertices, once each, to ids from 0 on
    """
    if check:
        partition.checked(g, refined)
    coarse_of = partition.compact(refined, check=False).select("v", F.col("c").alias("coarse"))
    nodes = g.nodes.join(coarse_of, "v").groupBy(F.col("coarse").alias("v")).agg(F.sum("node_size").alias("node_size"))
    e = partition.inside(g, coarse_of.withColumnRenamed("coarse", "c"))
    edges = e.groupBy(F.least("cu", "cv").alias("src"), F.greatest("cu", "cv").alias("dst")).agg(F.sum("w").alias("w"))
    return Contracted(Graph(nodes, edges), coarse_of)


WEIGHTS = {"binary": lambda: F.max(F.lit(1.0)), "count": lambda: F.count("*").cast("double"), "abs_sum": lambda: F.sum(F.abs("w"))}


def block_graph(g: Graph, assignment: DataFrame, mode: Literal["binary", "count", "abs_sum"] = "binary", n_blocks: int | None = None) -> Graph:
    """Blocks as vertices 0 .. n_blocks - 1 (by default the largest id), edges between different blocks only.

    Unassigned vertices' edges are left out; blocks that no vertex has are isolated. An empty assignment gives an
    empty graph.
    """
    spark = assignment.sparkSession
    n = partition.id_bound(assignment).first()[0] if n_blocks is None else n_blocks
    e = partition.inside(g, assignment).filter("cu <> cv")
    edges = e.groupBy(F.least("cu", "cv").alias("src"), F.greatest("cu", "cv").alias("dst")).agg(WEIGHTS[mode]().alias("w"))
    return Graph(spark.range(n).select(F.col("id").alias("v"), F.lit(1.0).alias("node_size")), edges)


def coarse_partition(coarse_of: DataFrame, assignment: DataFrame, refined: DataFrame | None = None, n_coarse: int | None = None) -> DataFrame:
    """(v, c) of the coarse vertices, with compact ids.

    :raises ValueError: if a coarse vertex lies in two communities, a vertex has none, or one has no coarse vertex. With
        refined, the assignment that was contracted: also if coarse_of isn't one to one with its communities. With
        n_coarse: also if the coarse vertices aren't 0 .. n_coarse - 1, each with a vertex.
    """
    both = coarse_of.join(assignment, "v", "full").groupBy("coarse").agg(F.min("c").alias("c"), F.max("c").alias("hi"), F.count(F.when(F.col("c").isNull() | (F.col("c") < 0), 1)).alias("none"))
    if both.filter("c <> hi or none > 0 or coarse is null or coarse < 0").take(1):
        raise ValueError("the contracted partition is no refinement of the assignment")
    if n_coarse is not None:
        r = both.agg(F.count("*").alias("n"), F.max("coarse").alias("hi")).first()
        if r["n"] != n_coarse or (n_coarse and r["hi"] != n_coarse - 1):
            raise ValueError(f"the coarse vertices aren't 0 to {n_coarse - 1}, each of some vertex")
    if refined is not None:
        pairs = coarse_of.join(refined.select("v", F.col("c").alias("part")), "v", "full").select("coarse", "part").distinct()
        r = pairs.agg(F.count("*").alias("n"), F.count_distinct("coarse").alias("a"), F.count_distinct("part").alias("b")).first()
        # a null on either side is a pair, but no distinct value
        if not r["n"] == r["a"] == r["b"]:
            raise ValueError("the coarse vertices aren't those of the refined communities")
    return partition.compact(both.select(F.col("coarse").alias("v"), "c"), check=False)


def flatten(to_coarse: DataFrame, coarse_of: DataFrame) -> DataFrame:
    """(v, coarse): the original vertices' places one level up."""
    up = coarse_of.select(F.col("v").alias("coarse"), F.col("coarse").alias("__up"))
    return to_coarse.join(up, "coarse").select("v", F.col("__up").alias("coarse"))
