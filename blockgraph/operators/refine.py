"""Refinement: within each community, vertices merge into well-connected parts, drawn at random by their gain.

Communities whose inner edges fit in a task are worked through there, many a task. A larger one is refined by rounds
over all its edges: of the vertices that are still alone, those propose that come before all such neighbours in a random
order, so that no two of them are neighbours; each draws a part by its gain, and of those that draw the same one the
first join, as long as their gains hold with the others before them. The parts' sums are kept by what joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import BROADCAST_ROWS, Graph
from ..runtime import cut, drop, few_broadcasts, running, ship
from . import partition
from .moves import Arrays, Form

#: Inner edges of a community that is refined in one task, at most.
TASK_EDGES = 1 << 21


def subset_mass(g: Graph, parent: DataFrame, objective) -> DataFrame:
    """(c, mass): each subset's summed refinement mass."""
    return partition.masses(g, objective).join(parent, "v").groupBy("c").agg(F.sum("x0").alias("mass"))


def weight_to_subset(g: Graph, parent: DataFrame) -> DataFrame:
    """(v, w): each vertex's weight to the rest of its own subset, without self-loops."""
    within = partition.inside(g, parent).filter("cu = cv and src <> dst")
    w = within.select(F.explode(F.array("src", "dst")).alias("v"), "w").groupBy("v").agg(F.sum("w").alias("w"))
    return g.nodes.select("v").join(w, "v", "left").fillna(0.0, ["w"])


def well_connected_nodes(g: Graph, parent: DataFrame, objective, m: float | None = None) -> DataFrame:
    """(v, c, ok): whether a vertex is tied well enough to the rest of its subset."""
    m = g.totals() if m is None else m
    x = partition.masses(g, objective).withColumnRenamed("x0", "x").join(parent, "v").join(subset_mass(g, parent, objective), "c").join(weight_to_subset(g, parent), "v")
    return x.select("v", "c", (F.col("w") >= objective.resolution(m) * F.col("x") * (F.col("mass") - F.col("x"))).alias("ok"))


def refinement_stats(g: Graph, parent: DataFrame, refined: DataFrame, objective) -> DataFrame:
    """(parent, c, n_members, mass, external_w) of each refined community; external_w is that to the rest of its parent."""
    both = parent.select("v", F.col("c").alias("parent")).join(refined, "v")
    stats = partition.masses(g, objective).join(both, "v").groupBy("parent", "c").agg(F.count("*").alias("n_members"), F.sum("x0").alias("mass"))
    side = lambda v, p, c: both.select(F.col("v").alias(v), F.col("parent").alias(p), F.col("c").alias(c))
    e = g.edges.join(side("src", "pu", "cu"), "src").join(side("dst", "pv", "cv"), "dst").filter("pu = pv and cu <> cv")
    ext = e.select(F.col("pu").alias("parent"), F.explode(F.array("cu", "cv")).alias("c"), "w").groupBy("parent", "c").agg(F.sum("w").alias("external_w"))
    return stats.join(ext, ["parent", "c"], "left").fillna(0.0, ["external_w"])


def well_connected_communities(g: Graph, parent: DataFrame, refined: DataFrame, objective, m: float | None = None) -> DataFrame:
    """refinement_stats with ok: whether the refined community is tied well enough to the rest of its parent."""
    m = g.totals() if m is None else m
    s = refinement_stats(g, parent, refined, objective).join(subset_mass(g, parent, objective).withColumnRenamed("mass", "whole").withColumnRenamed("c", "parent"), "parent")
    return s.withColumn("ok", F.col("external_w") >= objective.resolution(m) * F.col("mass") * (F.col("whole") - F.col("mass"))).drop("whole")


def advance_refinement(g: Graph, stats: DataFrame, parent: DataFrame, refined: DataFrame, moves: DataFrame, objective) -> DataFrame:
    """refinement_stats after moves (v, c) of vertices between refined communities, from those before.

    Only the edges of what moves are read; one whose ends both move is met from both, and counts half each time.
    """
    moved = refined.join(moves.select("v", F.col("c").alias("tgt")), "v").withColumnRenamed("c", "src").filter("src <> tgt").join(parent.select("v", F.col("c").alias("parent")), "v")
    x = partition.masses(g, objective).select("v", F.col("x0").alias("x")).join(moved, "v")
    at = refined.join(parent.select("v", F.col("c").alias("pu")), "v").select(F.col("v").alias("u"), F.col("c").alias("cu"), "pu")
    e = g.edges_of(moved).join(moved, "v").join(at, "u").filter("parent = pu").join(moved.select(F.col("v").alias("u"), F.col("tgt").alias("u_tgt"), F.lit(0.5).alias("half")), "u", "left")
    e = e.select("parent", "src", "tgt", "cu", F.coalesce("u_tgt", "cu").alias("cv"), (F.col("w") * F.coalesce("half", F.lit(1.0))).alias("w"))
    cut_ = e.filter("src <> cu").select("parent", F.explode(F.array("src", "cu")).alias("c"), (-F.col("w")).alias("external_w"))
    cut_ = cut_.union(e.filter("tgt <> cv").select("parent", F.explode(F.array("tgt", "cv")).alias("c"), "w"))
    n, zero = F.lit(1).cast("long"), F.lit(0.0)
    change = x.select("parent", F.col("src").alias("c"), (-n).alias("n_members"), (-F.col("x")).alias("mass"), zero.alias("external_w"))
    change = change.union(x.select("parent", F.col("tgt").alias("c"), n, "x", zero)).union(cut_.select("parent", "c", n * 0, zero, "external_w"))
    names = ["n_members", "mass", "external_w"]
    out = stats.select("parent", "c", *names).union(change).groupBy("parent", "c").agg(*[F.sum(k).alias(k) for k in names])
    return out.filter("n_members > 0")


class _Pool:
    """Places to draw one from; each is put in or taken out in constant time."""

    def __init__(self, held):
        self.items: list[int] = list(held)
        self.at = {c: i for i, c in enumerate(self.items)}

    def keep(self, c: int, held: bool) -> None:
        if held and c not in self.at:
            self.at[c] = len(self.items)
            self.items.append(c)
        elif not held and c in self.at:
            i, last = self.at.pop(c), self.items.pop()
            if last != c:
                self.items[i], self.at[last] = last, i

    def but(self, less: set[int]) -> int:
        """How many are none of less."""
        return len(self.items) - sum(c in self.at for c in less)

    def draw(self, less: set[int], rng: np.random.Generator) -> int:
        """One that is none of less, each as likely; there must be one."""
        if 2 * self.but(less) < len(self.items):
            left = [c for c in self.items if c not in less]
            return left[int(rng.integers(len(left)))]
        while (c := self.items[int(rng.integers(len(self.items)))]) in less:
            pass
        return c


def refine_kernel(a: Arrays, form: Form, theta: float, seed: int) -> np.ndarray:
    """Refined labels (places) of one subset's vertices; a holds its vertices and inner edges only.

    Parts without an edge to v gain alike, 0, unless masses of both signs are priced: they are drawn as one, from pools
    that are kept by what moved, so that the time is linear in vertices and edges. With both signs every part is looked at.
    """
    n = len(a.ids)
    x, prices = a.x, np.array(form.prices)
    whole = x.sum(0)
    tie = np.add.reduceat(np.append(a.w, 0.0), np.minimum(a.first[:-1], len(a.w)))
    tie[a.first[:-1] == a.first[1:]] = 0.0
    label = np.arange(n)
    part, count, outer = x.copy(), np.ones(n, np.int64), tie.astype(float).copy()
    # with one mass, a community without an edge to v can only be admissible when masses or weights allow a gain of 0
    everyone = len(prices) == 1 and bool((x <= 0).any() or (a.w < 0).any())
    mixed = everyone and bool((prices[0] < 0 and x.any()) or (prices[0] > 0 and (x < 0).any() and (x > 0).any()))
    tied = lambda c: form.unit * outer[c] >= float(prices @ (part[c] * (whole - part[c])))
    good = form.unit * tie >= (x * (whole - x)) @ prices
    if everyone and not mixed:
        every, weightless = _Pool(np.flatnonzero(good).tolist()), _Pool(np.flatnonzero(good & (x[:, 0] == 0)).tolist())
    rng = np.random.default_rng(seed)
    for v in rng.permutation(np.flatnonzero(good)).tolist():
        home = int(label[v])
        if count[home] != 1:
            continue
        near = {int(c): w for c, w in a.into(v, label).items()}
        targets, gains, times = [home], [0.0], [1]
        if mixed:
            able = (count > 0) & (form.unit * outer >= (part * (whole - part)) @ prices)
            able[home] = False
            delta = -prices[0] * x[v, 0] * part[:, 0]
            for c, w in near.items():
                delta[c] += form.unit * w
            far = np.flatnonzero(able & (delta >= 0))
            targets, gains, times = [home, *far.tolist()], [0.0, *delta[far].tolist()], [1] * (len(far) + 1)
        else:
            for c in sorted(near):
                if c != home and tied(c):
                    d = form.unit * near[c] - float(prices @ (x[v] * part[c]))
                    if d >= 0:
                        targets.append(c)
                        gains.append(d)
                        times.append(1)
            if everyone:
                pool, less = every if prices[0] * x[v, 0] == 0 else weightless, {home, *near}
                if others := pool.but(less):
                    targets.append(-1)
                    gains.append(0.0)
                    times.append(others)
        if len(targets) == 1:
            continue
        p = np.exp((np.array(gains) - max(gains)) / theta) * times
        to = targets[int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right").clip(0, len(targets) - 1))]
        if to == -1:
            to = pool.draw(less, rng)
        if to != home:
            label[v] = to
            count[home], count[to] = 0, count[to] + 1
            outer[to] += outer[home] - 2 * near.get(to, 0.0)
            part[to] += x[v]
            part[home] = outer[home] = 0.0
            if everyone and not mixed:
                for c in (home, to):
                    held = bool(count[c] > 0 and tied(c))
                    every.keep(c, held)
                    weightless.keep(c, held and part[c, 0] == 0)
    return label


def refine_rounds(nodes: DataFrame, inner: DataFrame, objective, m, theta: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Refinement of communities of any size: (v, c), and their parts' (p, c, n, x0, ..., ext) as kept on the way.

    nodes: (v, p, x0, ...), p being the community; inner: (v, u, w), its edges from both ends. Parts grow along edges.
    """
    with few_broadcasts(nodes.sparkSession):
        return _refine_rounds(nodes, inner, objective, m, theta, seed)


def _refine_rounds(nodes: DataFrame, inner: DataFrame, objective, m, theta: float, seed: int) -> tuple[DataFrame, DataFrame]:
    form, names = Form.of(objective, m), [c for c in nodes.columns if c not in ("v", "p")]
    rank = F.struct(F.xxhash64("v", F.lit(seed)).alias("h"), "v")
    # to be held against a part's sums and its community's whole
    dues = lambda mine, whole: sum((p * mine(k) * (whole(k) - mine(k)) for k, p in zip(names, form.prices, strict=True)), F.lit(0.0))
    whole = cut(nodes.groupBy("p").agg(*[F.sum(k).alias(f"all_{k}") for k in names]))
    inner = cut(inner)
    tie = inner.groupBy("v").agg(F.sum("w").alias("outer"))
    base = cut(nodes.join(tie, "v", "left").fillna(0.0, ["outer"]).join(whole, "p").withColumn("rank", rank))
    todo = base.filter(form.unit * F.col("outer") >= dues(F.col, lambda k: F.col(f"all_{k}"))).select("v", "p", *names, "outer", "rank")
    todo = cut(todo)
    at = cut(base.select("v", F.col("v").alias("c")))
    com = cut(base.select("p", F.col("v").alias("c"), F.lit(1).cast("long").alias("n"), *names, F.col("outer").alias("ext")))
    left = todo.count()
    while left:
        before = inner.join(todo.select("v", "rank"), "v").join(todo.select(F.col("v").alias("u"), F.col("rank").alias("u_rank")), "u").filter("u_rank < rank").select("v")
        turn = cut(todo.join(before.distinct(), "v", "left_anti"))
        near = inner.join(turn.select("v"), "v", "left_semi").join(at.withColumnRenamed("v", "u"), "u").groupBy("v", "c").agg(F.sum("w").alias("w"))
        part = com.join(whole, "p").filter(form.unit * F.col("ext") >= dues(F.col, lambda k: F.col(f"all_{k}")))
        part = part.select("c", "ext", *[F.col(k).alias(f"c_{k}") for k in names], *[f"all_{k}" for k in names])
        cand = near.join(turn, "v").filter("c <> v").join(part, "c")
        delta = form.unit * F.col("w") - sum((p * F.col(k) * F.col(f"c_{k}") for k, p in zip(names, form.prices, strict=True)), F.lit(0.0))
        own = turn.withColumns({"c": F.col("v"), "w": F.lit(0.0), "ext": F.lit(0.0), "delta": F.lit(0.0)} | {f"{b}_{k}": F.lit(0.0) for b in ("c", "all") for k in names})
        cand = cand.withColumn("delta", delta).filter("delta >= 0").unionByName(own)
        # the largest of gains over theta with Gumbel noise is a draw by their exponentials
        u = F.xxhash64("v", "c", F.lit(seed + 1)) / float(1 << 64) + 0.5
        noise = -F.log(-F.log(F.greatest(F.least(u, F.lit(1 - 1e-16)), F.lit(1e-300))))
        cols = ["c", "w", "ext", "delta", "outer", "rank", "p", *[f"{b}{k}" for b in ("", "c_", "all_") for k in names]]
        drawn = cand.withColumn("score", F.struct((F.col("delta") / theta + noise).alias("s"), F.col("c").alias("tie"))).groupBy("v").agg(F.max_by(F.struct(*cols), "score").alias("d")).select("v", "d.*")
        drawn = cut(drawn)
        go = drawn.filter("c <> v").withColumn("gone", F.col("outer") - 2 * F.col("w")).withColumnRenamed("c", "tgt")
        go = running(go, "tgt", "rank", {f"b_{k}": k for k in names} | {"b_ext": "gone"})
        now = lambda k: F.col(f"c_{k}") + F.col(f"b_{k}")
        holds = F.col("delta") - sum((p * F.col(k) * F.col(f"b_{k}") for k, p in zip(names, form.prices, strict=True)), F.lit(0.0)) >= 0
        holds = holds & (form.unit * (F.col("ext") + F.col("b_ext")) >= dues(now, lambda k: F.col(f"all_{k}")))
        # those before are no neighbours of v, so that w is still its weight into the part; and the first always joins
        go = go.withColumn("holds", holds)
        stop = go.filter("not holds").groupBy("tgt").agg(F.max("rank").alias("stop"))
        joins = cut(go.join(stop, "tgt", "left").filter("stop is null or rank > stop").select("v", "tgt", "gone", *names))
        seen = Observation()
        # done: who stayed or joined, and who was joined
        done = drawn.filter("c = v").select("v").union(joins.select("v")).union(joins.select("tgt"))
        next_todo = cut(todo.join(done, "v", "left_anti").observe(seen, F.count(F.lit(1)).alias("n")))
        next_at = cut(partition.apply_moves(at, joins.select("v", F.col("tgt").alias("c"))))
        more = joins.groupBy(F.col("tgt").alias("c")).agg(F.count("*").alias("d_n"), *[F.sum(k).alias(f"d_{k}") for k in names], F.sum("gone").alias("d_ext"))
        grown = com.join(joins.select(F.col("v").alias("c")), "c", "left_anti").join(more, "c", "left")
        next_com = cut(grown.select("p", "c", *[(F.col(k) + F.coalesce(F.col(f"d_{k}"), F.lit(0))).alias(k) for k in ("n", *names, "ext")]))
        drop(turn, drawn, joins, todo, at, com)
        todo, at, com, left = next_todo, next_at, next_com, seen.get["n"]
    drop(todo, inner, base, whole)
    return at, com


def refine(g: Graph, parent: DataFrame, objective, theta: float = 0.01, seed: int = 0, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, c): a refinement of parent; c is a member's id.

    Communities of more than task_edges inner edges are refined by rounds, each over all tasks, the others in a task
    that works through many. Parents are independent, and what is drawn depends on vertices' ids and the seed only:
    reruns agree, whatever the number of partitions. Parents in which nothing can merge (one vertex; no inner edge and
    no mass of 0) are not gathered. :raises ValueError: unless theta is positive.
    """
    if not theta > 0:
        raise ValueError("theta must be positive")
    ship(g.edges.sparkSession)
    m = g.totals()
    form = Form.of(objective, m)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        c, part, a, b, w = (rows[name].to_numpy() for name in ("c", "kind", "a", "b", "w"))
        x = rows[names].to_numpy(float)
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist()
        vs, cs = [], []
        for i, j in zip(cuts, [*cuts[1:], len(c)], strict=True):
            k = i + int(np.searchsorted(part[i:j], 1))
            if k == i:
                raise ValueError(f"the edges of community {c[i]} are not where its vertices are")
            sub = Arrays.of(a[i:k], x[i:k], a[k:j], b[k:j], w[k:j])
            label = refine_kernel(sub, form, theta, (seed * 1_000_003 + int(sub.ids[0])) & (1 << 63) - 1)
            vs.append(sub.ids)
            cs.append(sub.ids[label])
        return pd.DataFrame({"v": np.concatenate(vs), "c": np.concatenate(cs)})

    def run(frames):
        held: list[pd.DataFrame] = []
        for pdf in frames:
            if not len(pdf):
                continue
            # the last community may go on in the next frame
            c = pdf["c"].to_numpy()
            cut_ = int(np.searchsorted(c, c[-1]))
            if held and (cut_ or held[-1]["c"].iloc[-1] != c[-1]):
                yield settle(pd.concat([*held, pdf.iloc[:cut_]]))
                held = []
            elif cut_:
                yield settle(pdf.iloc[:cut_])
            held.append(pdf.iloc[cut_:])
        if held:
            yield settle(pd.concat(held))

    x = partition.masses(g, objective)
    names = [c for c in x.columns if c != "v"]
    nodes = x.join(g.spread(parent), "v")
    inner = partition.inside(g, parent).filter("cu = cv and src <> dst").select(F.col("cu").alias("c"), "src", "dst", "w")
    sizes = cut(inner.groupBy("c").agg(F.count("*").alias("k")))
    large = cut(sizes.filter(F.col("k") > task_edges).select("c"))
    idle = nodes.groupBy("c").agg(F.count("*").alias("n"), F.min("x0").alias("least")).filter("n > 1 and least <= 0").select("c")
    busy = cut(sizes.select("c").union(idle).distinct().join(large, "c", "left_anti"))
    # a merge by community would bring a large one's rows into one task, so they go before; large ones are few
    large, busy = (c if c.count() <= BROADCAST_ROWS else c.hint("merge") for c in (large, busy))
    small = nodes.join(large, "c", "left_anti")
    rows = small.join(busy, "c", "left_semi").select("c", F.lit(0).alias("kind"), F.col("v").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"), *names)
    rows = rows.union(inner.join(large, "c", "left_anti").join(busy, "c", "left_semi").select("c", F.lit(1), "src", "dst", "w", *[F.lit(0.0)] * len(names)))
    # by an expression of its own: a repartitioning by c is left out where both sides have it, and lost when they are joined otherwise at runtime
    dealt = rows.repartition(F.xxhash64("c")).sortWithinPartitions("c", "kind", "a", "b", "w")
    out = dealt.mapInPandas(run, "v long, c long")
    out = out.union(small.join(busy, "c", "left_anti").select("v", F.col("v").alias("c")))
    if large.take(1):
        both = inner.join(large, "c", "left_semi")
        both = both.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))).alias("e"), "w").select("e.v", "e.u", "w")
        out = out.union(refine_rounds(nodes.join(large, "c", "left_semi").withColumnRenamed("c", "p"), both, objective, m, theta, seed)[0])
    return out
