"""Metrics of a partition into blocks 0 .. n_blocks - 1, and of a colouring of the blocks.

A block id that is null or out of range counts as no block; densities and average degrees are means over all blocks,
empty ones included; empty inputs give zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import ranked
from . import contract, partition


def valid(assignment: DataFrame, n_blocks: int) -> DataFrame:
    """The assignment with ids outside 0 .. n_blocks - 1 as null."""
    return assignment.select("v", F.when((F.col("c") >= 0) & (F.col("c") < n_blocks), F.col("c")).alias("c"))


def per_block(g: Graph, assignment: DataFrame, n_blocks: int) -> DataFrame:
    """(block, nodes, internal_edges, degree): members, edges inside (self-loops once) and degree in the block graph."""
    a = valid(assignment, n_blocks)
    blocks = assignment.sparkSession.range(n_blocks).withColumnRenamed("id", "block")
    nodes = a.filter("c is not null").groupBy(F.col("c").alias("block")).agg(F.count("*").alias("nodes"))
    inner = partition.inside(g, a).filter("cu = cv").groupBy(F.col("cu").alias("block")).agg(F.count("*").alias("internal_edges"))
    degree = contract.block_graph(g, a, "binary", n_blocks).degree().withColumnRenamed("v", "block")
    return blocks.join(nodes, "block", "left").join(inner, "block", "left").join(degree, "block", "left").fillna(0)


def locality(g: Graph, assignment: DataFrame) -> DataFrame:
    """(internal_edges, external_edges, internal_ratio, locality_score); an edge without two blocks is external."""
    e = partition.inside(g, assignment).agg(F.count(F.when(F.col("cu") == F.col("cv"), 1)).alias("internal_edges"), F.count("*").alias("n"))
    e = e.withColumn("external_edges", F.col("n") - F.col("internal_edges"))
    return e.select("internal_edges", "external_edges", F.coalesce(F.try_divide("internal_edges", "n"), F.lit(0.0)).alias("internal_ratio"), (F.col("internal_edges") / (F.col("external_edges") + 1)).alias("locality_score"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """(gini) of one value a block; 0 without values or for a zero sum."""
    x = ranked(values.select(F.col(column).cast("double").alias("x")), "x", "place").withColumn("i", F.col("place") + 1)
    s, n = F.sum("x"), F.count("*")
    return x.agg(F.coalesce(F.when(s != 0, 2 * F.sum(F.col("i") * F.col("x")) / (n * s) - (n + 1) / n), F.lit(0.0)).alias("gini"))


def balance(blocks: DataFrame) -> DataFrame:
    """(avg_nodes, max_nodes, min_nodes, stddev, gini) over per_block rows; the population's standard deviation."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    a = blocks.agg(zero(F.avg("nodes")).cast("double").alias("avg_nodes"), zero(F.max("nodes")).alias("max_nodes"), zero(F.min("nodes")).alias("min_nodes"), zero(F.stddev_pop("nodes")).cast("double").alias("stddev"))
    return a.crossJoin(gini(blocks, "nodes"))  # two one-row tables


def density(blocks: DataFrame) -> DataFrame:
    """(avg_block_density, mean_internal_avg_degree) over per_block rows."""
    n, k = F.col("nodes"), F.col("internal_edges")
    return blocks.agg(
        F.coalesce(F.sum(F.when(n > 1, k / (n * (n - 1) / 2))) / F.count("*"), F.lit(0.0)).alias("avg_block_density"),
        F.coalesce(F.sum(F.when(n > 0, 2 * k / n)) / F.count("*"), F.lit(0.0)).alias("mean_internal_avg_degree"),
    )


def block_graph_stats(blocks: DataFrame) -> DataFrame:
    """(block_graph_edges, block_graph_density, avg_block_graph_degree) over per_block rows."""
    b = blocks.agg(F.coalesce(F.sum("degree") / 2, F.lit(0)).cast("long").alias("block_graph_edges"), F.count("*").alias("n"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_block_graph_degree"))
    return b.select("block_graph_edges", F.when(F.col("n") > 1, F.col("block_graph_edges") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("block_graph_density"), "avg_block_graph_degree")


def modularity_unweighted(g: Graph, assignment: DataFrame) -> DataFrame:
    """(modularity): edges count 1, a self-loop adds 1 to its vertex's degree; 0 without edges."""
    a = assignment.filter("c is not null")
    k = g.degree().join(a, "v").groupBy("c").agg(F.sum("degree").alias("k"))
    inner = partition.inside(g, a).filter("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count("*").alias("l"))
    m = g.edges.agg(F.count("*").alias("m"))
    return _modularity(k.join(inner, "c", "left").fillna(0), m)


def modularity_weighted(g: Graph, assignment: DataFrame) -> DataFrame:
    """(modularity) of absolute weights: totals and inner weights leave self-loops out, strengths hold them once."""
    a, w = assignment.filter("c is not null"), F.abs("w")
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    k = g.edges.select(F.explode(ends).alias("v"), w.alias("w")).join(a, "v").groupBy("c").agg(F.sum("w").alias("k"))
    inner = partition.inside(g, a).filter("cu = cv and src <> dst").groupBy(F.col("cu").alias("c")).agg(F.sum(w).alias("l"))
    m = g.edges.filter("src <> dst").agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("m"))
    return _modularity(k.join(inner, "c", "left").fillna(0), m)


def _modularity(blocks: DataFrame, m: DataFrame) -> DataFrame:
    one = m.crossJoin(blocks.agg(F.sum("l").alias("l"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk")))  # two one-row tables
    return one.select(F.coalesce(F.when(F.col("m") != 0, F.col("l") / F.col("m") - F.col("kk") / (4.0 * F.col("m") * F.col("m"))), F.lit(0.0)).alias("modularity"))


def per_color(assignment: DataFrame, colors: DataFrame, n_colors: int) -> DataFrame:
    """(color, blocks, nodes, avg_nodes_per_block); colors: (v, color) of blocks. Colours without blocks have zeros."""
    spark = assignment.sparkSession
    c = colors.filter((F.col("color") >= 0) & (F.col("color") < n_colors)).select(F.col("v").alias("c"), "color")
    nodes = assignment.join(c, "c").groupBy("color").agg(F.count("*").alias("nodes"))
    out = spark.range(n_colors).withColumnRenamed("id", "color").join(c.groupBy("color").agg(F.count("*").alias("blocks")), "color", "left").join(nodes, "color", "left").fillna(0)
    return out.withColumn("avg_nodes_per_block", F.coalesce(F.try_divide("nodes", "blocks"), F.lit(0.0)))


def imbalance(blocks: DataFrame, by_color: DataFrame) -> DataFrame:
    """(block_imbalance, color_imbalance): largest over mean number of nodes; 0 for an empty side."""
    one = lambda df, name: df.agg(F.coalesce(F.try_divide(F.max("nodes"), F.avg("nodes")), F.lit(0.0)).alias(name))
    return one(blocks, "block_imbalance").crossJoin(one(by_color, "color_imbalance"))  # two one-row tables


def report(g: Graph, assignment: DataFrame, n_blocks: int, colors: DataFrame | None = None, n_colors: int = 0) -> DataFrame:
    """All metrics as one row; with a colour for each block also the blocks and nodes of each colour, as arrays by colour.

    What each block has (nodes, inner edges, degree) is per_block's, as there may be many blocks.
    """
    a = valid(assignment, n_blocks)
    blocks = per_block(g, a, n_blocks)
    out = g.nodes.agg(F.count("*").alias("num_vertices")).crossJoin(g.edges.agg(F.count("*").alias("num_edges")))
    out = out.withColumns({"num_blocks": F.lit(n_blocks).cast("long"), "num_colors": F.lit(n_colors).cast("long")})
    parts = [locality(g, a), balance(blocks), density(blocks), block_graph_stats(blocks), modularity_unweighted(g, a).withColumnRenamed("modularity", "modularity_unweighted"), modularity_weighted(g, a).withColumnRenamed("modularity", "modularity_weighted")]
    if colors is not None and n_colors > 0 and colors.count() >= n_blocks:
        each = per_color(a, colors, n_colors)
        listed = F.array_sort(F.collect_list(F.struct("color", "blocks", "nodes")))
        parts += [imbalance(blocks, each), each.agg(listed.alias("x")).select(F.col("x.blocks").alias("blocks_per_color"), F.col("x.nodes").alias("nodes_per_color"))]
    for p in parts:
        out = out.crossJoin(p)  # one-row tables
    return out


def text(row) -> str:
    """A report row as lines of `name: value`."""
    return "\n".join(f"{k}: {v}" for k, v in row.asDict().items())
