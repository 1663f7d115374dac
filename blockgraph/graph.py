"""Undirected weighted multigraphs as DataFrames.

``nodes(v, node_size)`` and ``edges(src, dst, w)`` with src <= dst, one row for each undirected edge; parallel edges
and self-loops are rows like others. A self-loop adds twice its weight to its vertex's strength, once to its degree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.quality import Totals
from .runtime import cut

#: Rows of the adjacency that one of its parts holds, about, and parts at most.
PART_ROWS, PARTS = 1 << 16, 4096
#: Vertices of a graph whose tables a join may broadcast, at most.
BROADCAST_ROWS = 200_000


def _part(v, parts: int):
    return F.pmod(F.xxhash64(v), F.lit(parts)).cast("int")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: sym() and strengths() as tables, where they are kept
    kept: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)
    #: parts by vertex that the kept sym() is stored in
    parts: int = 1
    #: with more than BROADCAST_ROWS vertices, as far as that is known
    large: bool = False

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str = "src", dst: str = "dst", w: str | None = None, nodes: DataFrame | None = None, large: bool = False) -> Graph:
        """A graph of any edge DataFrame; weights default to 1, vertices to the edges' ends, their sizes to 1.

        large: there are more than BROADCAST_ROWS vertices; `persist` finds that out by itself.
        """
        weight = F.lit(1.0) if w is None else F.col(w).cast("double")
        e = edges.select(F.least(src, dst).cast("long").alias("src"), F.greatest(src, dst).cast("long").alias("dst"), weight.alias("w"))
        if nodes is None:
            nodes = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct()
        size = F.col("node_size").cast("double") if "node_size" in nodes.columns else F.lit(1.0)
        return cls(nodes.select(F.col("v").cast("long").alias("v"), size.alias("node_size")), e, large=large)

    def persist(self) -> Graph:
        """The graph as tables in the shared folder."""
        nodes = cut(self.nodes)
        # read from the files' footers
        return Graph(nodes, cut(self.edges), large=self.large or nodes.count() > BROADCAST_ROWS)

    def spread(self, df: DataFrame) -> DataFrame:
        """df, a row for each vertex, as a side of a join by vertex: of a large graph sorted and merged, not broadcast.

        Ids fill small files, and Spark goes by these; the rows would go through the driver and into every task.
        """
        return df.hint("merge") if self.large else df

    def prepared(self) -> Graph:
        """The graph with sym() and strengths() as tables, for operators that need them again and again.

        The adjacency is stored in parts by vertex, so that `edges_of` reads those of the vertices that it is asked for.
        """
        if self.kept:
            return self
        parts = max(1, min(PARTS, 2 * self.edges.count() // PART_ROWS))
        sym = self.sym()
        if parts > 1:
            # large parts, as of a vertex with many neighbours, are split over files
            sym = cut(sym.withColumn("part", _part(F.col("v"), parts)).hint("rebalance", "part"), by="part")
        else:
            sym = cut(sym)
        return Graph(self.nodes, self.edges, {"sym": sym, "strengths": cut(self.strengths())}, parts, self.large)

    def edges_of(self, only: DataFrame) -> DataFrame:
        """(v, u, w): sym() of the vertices (v) only; of a prepared graph only the parts are read that hold them."""
        sym = self.kept.get("sym")
        if sym is None:
            sym = self.sym()
        elif self.parts > 1:
            held = [r[0] for r in only.select(_part(F.col("v"), self.parts).alias("part")).distinct().collect()]
            sym = sym.filter(F.col("part").isin(held)) if len(held) < self.parts else sym
        return sym.join(only.select("v"), "v", "left_semi").select("v", "u", "w")

    def scan_edges(self, run, schema: str) -> DataFrame:
        """What a function makes of the edges: run takes an iterator over Arrow batches (src, dst, w) and yields batches
        of the schema. Each edge is seen once, with src <= dst, in no order; every task calls run once."""
        return self.edges.select("src", "dst", "w").mapInArrow(run, schema)

    def binary(self) -> Graph:
        """Every weight 1; parallel edges stay parallel."""
        return Graph(self.nodes, self.edges.withColumn("w", F.lit(1.0)), large=self.large)

    def sym(self) -> DataFrame:
        """(v, u, w): each edge but self-loops from both of its ends."""
        if "sym" in self.kept:
            return self.kept["sym"].select("v", "u", "w")
        e = self.edges.filter("src <> dst")
        both = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))
        return e.select(F.explode(both).alias("e"), "w").select("e.v", "e.u", "w")

    def loops(self) -> DataFrame:
        """(v, w): summed self-loop weight of the vertices that have any."""
        return self.edges.filter("src = dst").groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("w"))

    def degree(self) -> DataFrame:
        """(v, degree) of every vertex: parallel edges count each, a self-loop once."""
        ends = self.edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("v"))
        return self.spread(self.nodes.select("v")).join(ends.groupBy("v").agg(F.count("*").alias("degree")), "v", "left").fillna(0, ["degree"])

    def strengths(self) -> DataFrame:
        """nodes with strength: summed weights, those of self-loops twice."""
        if "strengths" in self.kept:
            return self.kept["strengths"]
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("v"), "w").groupBy("v").agg(F.sum("w").alias("strength"))
        return self.spread(self.nodes).join(ends, "v", "left").fillna(0.0, ["strength"])

    def signed_strengths(self) -> DataFrame:
        """strengths() with above and below: summed weights of the positive and of the negative edges, as positive
        numbers, those of self-loops twice."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("v"), "w").groupBy("v")
        ends = ends.agg(F.sum(F.greatest("w", F.lit(0.0))).alias("above"), F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("below"))
        return self.spread(self.strengths()).join(ends, "v", "left").fillna(0.0, ["above", "below"])

    def totals(self) -> Totals:
        """What an objective's prices may depend on."""
        w = self.edges.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("w"), F.greatest("w", F.lit(0.0)), F.greatest(-F.col("w"), F.lit(0.0)))]).first()
        size = self.nodes.agg(F.coalesce(F.sum("node_size"), F.lit(0.0))).first()[0]
        return Totals(w[0], size, w[1], w[2])

    def total_weight(self) -> float:
        """Summed weight of all edges, self-loops once."""
        return self.edges.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

    def num_vertices(self) -> int:
        return self.nodes.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def edge_weight(self, a: int, b: int) -> DataFrame:
        """(w) of one edge between a and b, or no row."""
        return self.edges.filter((F.col("src") == min(a, b)) & (F.col("dst") == max(a, b))).select("w").limit(1)

    def strangers(self) -> DataFrame:
        """Edges with an end that is no vertex; empty for a valid graph."""
        known = self.nodes.select("v")
        off = lambda c: self.edges.join(known, self.edges[c] == known["v"], "left_anti")
        return off("src").union(off("dst")).distinct()
