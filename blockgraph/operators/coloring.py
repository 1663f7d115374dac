"""Greedy colouring of (block) graphs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import cut, drop, ranked, ship

#: Vertices and edges of the order that one task colours, about.
PART_ROWS = 1 << 20


def greedy(g: Graph, part_rows: int = PART_ROWS) -> DataFrame:
    """(v, color): the colours of the greedy order (degree descending, id ascending), exactly as found one by one.

    The order is cut into stretches of about part_rows vertices and edges, a task each. In a round every task colours
    its vertices in order as far as it can: a vertex whose earlier neighbours all have their colours, from this round in
    the same stretch or from rounds before, takes the least that none of them has. So a chain of such dependencies costs
    a round only where it goes over to another stretch, and after k rounds k stretches are done at least. Rounds look at
    what has no colour yet only.
    """
    ship(g.edges.sparkSession)
    g = g.prepared()
    placed = ranked(g.degree().select("v", F.struct((-F.col("degree")).alias("d"), "v").alias("r")), "r", "place").select("v", "place")
    parts = max(1, -(-(g.num_edges() + g.num_vertices()) // part_rows))
    n = max(1, g.num_vertices())
    placed = cut(placed.withColumn("part", F.floor(F.col("place") * parts / n).cast("int")))
    # each edge from the later vertex to the earlier one
    wait = g.sym().select("v", "u").distinct().join(placed, "v").join(placed.select(F.col("v").alias("u"), F.col("place").alias("at")), "u").filter("at < place")
    none = F.array().cast("array<long>")
    todo = placed.join(wait.groupBy("v").agg(F.collect_list("u").alias("waits")), "v", "left").select("v", "place", "part", none.alias("used"), F.coalesce("waits", none).alias("waits"))
    todo, found, left = cut(todo), [], g.num_vertices()
    while left:
        seen = Observation()
        new = todo.repartition("part").sortWithinPartitions("part", "place").mapInPandas(_stretches, "v long, color long")
        new = cut(new.observe(seen, F.count(F.lit(1)).alias("n")))
        found.append(new)
        left -= seen.get["n"]
        if not left:
            break
        rest = todo.join(new, "v", "left_anti")
        known = rest.select("v", F.explode("waits").alias("u")).join(new.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.collect_set("color").alias("colors"), F.collect_list("u").alias("seen"))
        rest = rest.join(known, "v", "left").select("v", "place", "part", F.array_union("used", F.coalesce("colors", none)).alias("used"), F.array_except("waits", F.coalesce("seen", none)).alias("waits"))
        old, todo = todo, cut(rest)
        drop(old)
    drop(todo, placed)
    spark = g.edges.sparkSession
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], "v long, color long")


def _stretches(frames):
    """Colours of the vertices that can be coloured, for stretches in order; one stretch's colours are held at a time."""
    part, color = None, {}
    for pdf in frames:
        vs, cs = [], []
        for v, p, used, waits in zip(pdf["v"].tolist(), pdf["part"].tolist(), pdf["used"], pdf["waits"], strict=True):
            if p != part:
                part, color = p, {}
            near = [color.get(u) for u in waits.tolist()]
            if None in near:
                continue
            taken = {*used.tolist(), *near}
            color[v] = next(c for c in range(len(taken) + 1) if c not in taken)
            vs.append(v)
            cs.append(color[v])
        yield pd.DataFrame({"v": np.array(vs, np.int64), "color": np.array(cs, np.int64)})


def _kernel(g: Graph, color) -> DataFrame:
    """color(order, neighbours) -> colours, in one task; for graphs of blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {v: [] for v in sorted(pdf.loc[pdf["u"].isna(), "v"].tolist())}
        for v, u in pdf[["v", "u"]].dropna().astype("int64").drop_duplicates().itertuples(index=False):
            near[v].append(u)
        degree = dict(pdf.loc[pdf["u"].isna(), ["v", "d"]].itertuples(index=False))
        out = color(sorted(near, key=lambda v: (-degree[v], v)), near)
        return pd.DataFrame({"v": list(out), "color": list(out.values())})

    ship(g.edges.sparkSession)
    deg = g.degree().select("v", F.lit(None).cast("double").alias("u"), F.col("degree").cast("double").alias("d"))
    rows = deg.union(g.sym().select("v", F.col("u").cast("double"), F.lit(0.0)))
    return rows.groupBy().applyInPandas(run, "v long, color long")


def _sequential(order: list[int], near: dict[int, list[int]]) -> dict[int, int]:
    color: dict[int, int] = {}
    for v in order:
        used = {color[u] for u in near[v] if u in color}
        color[v] = next(c for c in range(len(used) + 1) if c not in used)
    return color


def _balanced(order: list[int], near: dict[int, list[int]]) -> dict[int, int]:
    color: dict[int, int] = {}
    size: list[int] = []
    for v in order:
        used = {color[u] for u in near[v] if u in color}
        free = [(n, c) for c, n in enumerate(size) if c not in used]
        c = min(free)[1] if free else len(size)
        if c == len(size):
            size.append(0)
        size[c] += 1
        color[v] = c
    return color


def _levelled(order: list[int], near: dict[int, list[int]]) -> dict[int, int]:
    color = _sequential(order, near)
    classes: dict[int, set[int]] = {c: set() for c in range(max(color.values(), default=-1) + 1)}
    for v, c in color.items():
        classes[c].add(v)

    def move():
        """The first legal one: largest source, smallest target, lowest id; the lower colour of equal classes."""
        size = {c: len(x) for c, x in classes.items()}
        for a in sorted(size, key=lambda c: (-size[c], c)):
            for b in sorted((c for c in size if size[c] + 1 < size[a]), key=lambda c: (size[c], c)):
                v = min((v for v in classes[a] if all(color[u] != b for u in near[v])), default=None)
                if v is not None:
                    return v, a, b
        return None

    for _ in range(10 * len(color)):
        if not (found := move()):
            break
        v, a, b = found
        classes[a].remove(v)
        classes[b].add(v)
        color[v] = b
    return color


def greedy_balanced(g: Graph) -> DataFrame:
    """(v, color): in the greedy order, the smallest permitted class (lowest colour of equals), a new one if none is."""
    return _kernel(g, _balanced)


def greedy_levelled(g: Graph) -> DataFrame:
    """(v, color): the greedy colours, then moves from larger to smaller classes while any pair differs by two and has a legal one."""
    return _kernel(g, _levelled)


def relabel_by_size(colors: DataFrame) -> DataFrame:
    """Colours renumbered by class size, the largest first; of equals the lower old colour first."""
    classes = colors.groupBy("color").agg(F.count("*").alias("n"))
    new = classes.select("color", (F.row_number().over(Window.orderBy(F.desc("n"), "color")) - 1).cast("long").alias("new"))
    return colors.join(new, "color").select("v", F.col("new").alias("color"))


def violations(g: Graph, colors: DataFrame, n_colors: int | None = None) -> DataFrame:
    """(fault, n): vertices without a colour, colours out of range, neighbours of one colour (self-loops don't count)."""
    n = colors.agg(F.coalesce(F.max("color") + 1, F.lit(0))).first()[0] if n_colors is None else n_colors
    one = lambda name, df: df.agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
    side = lambda v, c: g.spread(colors.select(F.col("v").alias(v), F.col("color").alias(c)))
    clash = g.edges.filter("src <> dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst").filter("a = b")
    return one("uncoloured", g.spread(g.nodes).join(colors, "v", "left_anti")).union(one("out_of_range", colors.filter((F.col("color") < 0) | (F.col("color") >= n)))).union(one("clash", clash))
