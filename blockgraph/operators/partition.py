"""Assignments (v, c) of vertices to communities, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import ranked


def singletons(g: Graph) -> DataFrame:
    """Each vertex alone, in the community of its own id."""
    return g.nodes.select("v", F.col("v").alias("c"))


def inside(g: Graph, assignment: DataFrame) -> DataFrame:
    """edges with cu and cv, the communities of their ends (null if unassigned)."""
    side = lambda v, c: g.spread(assignment.select(F.col("v").alias(v), F.col("c").alias(c)))
    return g.edges.join(side("src", "cu"), "src", "left").join(side("dst", "cv"), "dst", "left")


def communities(g: Graph, assignment: DataFrame) -> DataFrame:
    """(c, n_members, size, strength, internal_w); unassigned vertices are left out."""
    a = assignment.filter("c is not null")
    members = g.strengths().join(g.spread(a), "v").groupBy("c").agg(F.count("*").alias("n_members"), F.sum("node_size").alias("size"), F.sum("strength").alias("strength"))
    internal = inside(g, a).filter("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("internal_w"))
    return members.join(internal, "c", "left").fillna(0.0, ["internal_w"])


def masses(g: Graph, objective) -> DataFrame:
    """(v, x0, x1, ...): an objective's masses of each vertex."""
    at = g.signed_strengths() if objective.signed else g.strengths()
    return at.select("v", *[x.cast("double").alias(f"x{k}") for k, x in enumerate(objective.masses())])


def community_masses(x: DataFrame, assignment: DataFrame) -> DataFrame:
    """(c, n_members, x0, ...): members and summed masses x, of `masses`, of each community."""
    sums = [F.sum(c).alias(c) for c in x.columns if c != "v"]
    return x.join(assignment.filter("c is not null"), "v").groupBy("c").agg(F.count("*").alias("n_members"), *sums)


def valued(g: Graph, assignment: DataFrame, objective) -> DataFrame:
    """(c, n_members, x0, ..., internal_w): communities as an objective's quality takes them."""
    a = assignment.filter("c is not null")
    internal = inside(g, a).filter("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("internal_w"))
    return community_masses(masses(g, objective), g.spread(a)).join(internal, "c", "left").fillna(0.0, ["internal_w"])


def quality(g: Graph, assignment: DataFrame, objective) -> float:
    return valued(g, assignment, objective).agg(objective.quality(g.totals())).first()[0]


def advance_masses(com: DataFrame, moved: DataFrame, x: DataFrame) -> DataFrame:
    """community_masses after moves (v, src, c), from those before: only what moved is summed; emptied communities go."""
    names = [c for c in x.columns if c != "v"]
    m = moved.join(x, "v")
    leaves = m.select(F.col("src").alias("c"), F.lit(-1).cast("long").alias("n_members"), *[(-F.col(k)).alias(k) for k in names])
    joins = m.select("c", F.lit(1).cast("long").alias("n_members"), *names)
    change = leaves.union(joins).groupBy("c").agg(*[F.sum(k).alias(f"d_{k}") for k in ("n_members", *names)])
    both = com.join(change, "c", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("c", *[(zero(k) + zero(f"d_{k}")).alias(k) for k in ("n_members", *names)]).filter("n_members > 0")


def advance_communities(g: Graph, com: DataFrame, assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """communities() after moves (v, c), from those before: only the edges of what moves are read.

    An edge whose ends both move is met from both, and counts half each time.
    """
    to = moves.select("v", F.col("c").alias("tgt"))
    moved = g.spread(assignment).join(to, "v").withColumnRenamed("c", "src").filter("not src <=> tgt")
    at = g.spread(assignment.select(F.col("v").alias("u"), F.col("c").alias("cu")))
    e = g.edges_of(g.spread(moved)).join(g.spread(moved), "v").join(at, "u").join(g.spread(moved.select(F.col("v").alias("u"), F.col("tgt").alias("u_tgt"), F.lit(0.5).alias("half"))), "u", "left")
    e = e.select("src", "tgt", "cu", F.coalesce("u_tgt", "cu").alias("cv"), (F.col("w") * F.coalesce("half", F.lit(1.0))).alias("w"))
    zero = F.lit(0.0)
    n = F.lit(1).cast("long")
    row = lambda df, c, k, size, strength, w: df.select(F.col(c).alias("c"), k.alias("n_members"), size.alias("size"), strength.alias("strength"), w.alias("internal_w"))
    m = g.strengths().join(g.spread(moved), "v").join(g.loops().withColumnRenamed("w", "loop"), "v", "left").fillna(0.0, ["loop"])
    size, strength, w = F.col("node_size"), F.col("strength"), F.col("w")
    change = row(m, "src", -n, -size, -strength, -F.col("loop")).union(row(m, "tgt", n, size, strength, F.col("loop")))
    change = change.union(row(e.filter("cu = src"), "src", n * 0, zero, zero, -w)).union(row(e.filter("cv = tgt"), "tgt", n * 0, zero, zero, w))
    names = ["n_members", "size", "strength", "internal_w"]
    out = com.select("c", *names).union(change.select("c", *names).filter("c is not null")).groupBy("c").agg(*[F.sum(k).alias(k) for k in names])
    return out.filter("n_members > 0")


def id_bound(assignment: DataFrame) -> DataFrame:
    """(n): the largest id plus one, 0 without any."""
    return assignment.agg(F.coalesce(F.max("c") + 1, F.lit(0)).cast("long").alias("n"))


def active(assignment: DataFrame) -> DataFrame:
    """(n): number of communities in use."""
    return assignment.agg(F.count_distinct("c").alias("n"))


def neighbour_weights(g: Graph, assignment: DataFrame) -> DataFrame:
    """(v, c, w): each vertex's summed weight into each neighbouring community, without self-loops."""
    a = g.spread(assignment.filter("c is not null").withColumnRenamed("v", "u"))
    return g.sym().join(a, "u").groupBy("v", "c").agg(F.sum("w").alias("w"))


def weight_into(g: Graph, assignment: DataFrame, v: int, c: int, with_loop: bool = False) -> DataFrame:
    """(w): weight from one vertex into one community, with its self-loops if it is in there and they are wanted."""
    out = neighbour_weights(g, assignment).filter((F.col("v") == v) & (F.col("c") == c)).select("w")
    if with_loop:
        out = out.union(g.loops().join(assignment, "v").filter((F.col("v") == v) & (F.col("c") == c)).select("w"))
    return out.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def compact_ids(ids: DataFrame, column: str = "c") -> DataFrame:
    """(column, compact): ids in ascending order as 0, 1, ..."""
    return ranked(ids.select(column).filter(F.col(column).isNotNull()).distinct(), column, "compact")


def compact(assignment: DataFrame, check: bool = True) -> DataFrame:
    """The assignment with ids 0, 1, ... in the old order. :raises ValueError: if an id is null or negative and check is set."""
    if check and assignment.filter("c is null or c < 0").take(1):
        raise ValueError("every vertex needs a community, whose id isn't negative")
    return assignment.join(compact_ids(assignment), "c").select("v", F.col("compact").alias("c"))


def members(assignment: DataFrame) -> DataFrame:
    """(c, members): each community's vertices, ascending."""
    return assignment.filter("c is not null").groupBy("c").agg(F.array_sort(F.collect_list("v")).alias("members"))


def apply_moves(assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """The assignment after moves (v, c)."""
    return assignment.join(moves.select("v", F.col("c").alias("__to")), "v", "left").select("v", F.coalesce("__to", "c").alias("c"))


def smallest_unused(assignment: DataFrame) -> DataFrame:
    """(c): the smallest id that no vertex has; 0 for an empty assignment."""
    used = assignment.select("c").filter("c >= 0").distinct()
    after = used.select((F.col("c") + 1).alias("c")).union(assignment.sparkSession.createDataFrame([(0,)], "c long"))
    return after.join(used, "c", "left_anti").agg(F.min("c").alias("c"))


def faults(g: Graph, assignment: DataFrame) -> DataFrame:
    """(fault, n): vertices without a row, rows without a vertex, vertices with several rows, null or negative ids."""
    one = lambda name, df: df.agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
    return (
        one("missing", g.spread(g.nodes).join(assignment, "v", "left_anti"))
        .union(one("unknown", g.spread(assignment).join(g.nodes, "v", "left_anti")))
        .union(one("repeated", assignment.groupBy("v").count().filter("count > 1")))
        .union(one("unassigned", assignment.filter("c is null or c < 0")))
    )


def checked(g: Graph, assignment: DataFrame) -> DataFrame:
    """The assignment. :raises ValueError: if it has faults."""
    bad = {r["fault"]: r["n"] for r in faults(g, assignment).collect() if r["n"]}
    if bad:
        raise ValueError(f"not an assignment of this graph's vertices: {bad}")
    return assignment


def blocks(assignment: DataFrame) -> DataFrame:
    """(block, members) of a compact assignment. :raises ValueError: if an id is null or negative, or one is unused."""
    r = assignment.agg(F.count_distinct("c").alias("k"), F.coalesce(F.max("c") + 1, F.lit(0)).alias("n"), F.coalesce(F.min("c"), F.lit(0)).alias("lo"), F.count(F.when(F.col("c").isNull(), 1)).alias("none")).first()
    if r["none"] or r["lo"] < 0 or r["k"] != r["n"]:
        raise ValueError("block ids must be 0, 1, ... without gaps")
    return members(assignment).withColumnRenamed("c", "block")
