"""Local moving: vertices move to the community that improves the objective most, until none can.

Quality never falls, and at the end no single move gains more than rounding.
`local_move` makes rounds of moves as DataFrame plans: many join one community, each with its exact gain after those
before. A round reads the edges of the vertices it looks at only, and keeps the communities' sums by what moved.
`local_move_queue` first works through a queue of vertices in each of many blocks, side by side, each with the others'
vertices as they were; what the blocks have done together is taken when it gains. Rounds end it.
"""

from __future__ import annotations

import logging
import time
from collections import deque
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import totals
from ..graph import Graph
from ..runtime import cut, drop, ranked, running, ship
from . import partition

log = logging.getLogger(__name__)

#: Gains up to this, or this share of the largest strength, are rounding.
EPS, RELATIVE = 1e-12, 1e-13
#: Rows of the adjacency that one block of the queue holds, about, and edges of a vertex that the queue moves at most.
BLOCK_ROWS, HUB = 2_000_000, 200_000
PROFILE = "level int, turn int, way string, looked_at long, proposals long, moves long, fresh long, gain double, seconds double"


@dataclass
class Moved:
    assignment: DataFrame
    moves: int
    visits: int
    #: a row for each round, as PROFILE has them
    rounds: list[dict] = field(default_factory=list)


def profile(spark: SparkSession, levels: list[list[dict]]) -> DataFrame:
    """The rounds of each level, as a table."""
    rows = [(k + 1, *(r[c.split()[0]] for c in PROFILE.split(", ")[1:])) for k, rounds in enumerate(levels) for r in rounds]
    return spark.createDataFrame(rows, PROFILE)


def tolerance(g: Graph) -> float:
    """Gains up to this are rounding in sums of this graph's weights."""
    largest = g.strengths().agg(F.max(F.abs("strength"))).first()[0] or 0.0
    return max(EPS, RELATIVE * largest)


def candidates(g: Graph, assignment: DataFrame, objective, m=None, empty: bool = True, only: DataFrame | None = None, x: DataFrame | None = None, com: DataFrame | None = None) -> DataFrame:
    """(v, src, tgt, delta): for each vertex its neighbouring communities and, as a null tgt, an empty one.

    only: (v) restricts the vertices, and the edges that are read to theirs. x and com: masses and community_masses,
    where they are at hand.
    """
    m = g.totals() if m is None else m
    x = partition.masses(g, objective) if x is None else x
    names = [c for c in x.columns if c != "v"]
    placed = assignment.filter("c is not null")
    # every join of it is by vertex; of few vertices a round settles it itself
    placed = g.spread(placed) if only is None else placed
    com = partition.community_masses(x, placed) if com is None else com
    near = g.sym() if only is None else g.edges_of(only)
    near = near.join(placed.withColumnRenamed("v", "u"), "u").groupBy("v", "c").agg(F.sum("w").alias("w"))
    base = x.join(placed if only is None else placed.join(only.select("v"), "v", "left_semi"), "v").withColumnRenamed("c", "src")
    base = base.join(near.select("v", F.col("c").alias("src"), F.col("w").alias("w_src")), ["v", "src"], "left").fillna(0.0, ["w_src"])
    base = base.join(com.select(F.col("c").alias("src"), F.col("n_members").alias("src_n"), *[F.col(k).alias(f"src_{k}") for k in names]), "src")
    to = base.join(near.select("v", F.col("c").alias("tgt"), F.col("w").alias("w_tgt")), "v").filter("src <> tgt")
    to = to.join(com.select(F.col("c").alias("tgt"), *[F.col(k).alias(f"tgt_{k}") for k in names]), "tgt")
    cols = ["v", "src", "tgt", "w_src", "w_tgt", *[f"{side}{k}" for k in names for side in ("", "src_", "tgt_")]]
    out = to.select(*cols)
    if empty:
        zero = F.lit(0.0)
        # a vertex that is alone already has its empty community
        out = out.unionByName(base.filter("src_n > 1").withColumns({"tgt": F.lit(None).cast("long"), "w_tgt": zero} | {f"tgt_{k}": zero for k in names}).select(*cols))
    return out.select("v", "src", "tgt", objective.delta(m).alias("delta"))


def best_moves(cand: DataFrame, eps: float = EPS) -> DataFrame:
    """(v, src, tgt, delta): each vertex's best move that gains more than eps; of equals the smaller id, empty last."""
    rank = F.struct("delta", (-F.coalesce("tgt", F.lit((1 << 63) - 1))).alias("t"))
    best = cand.filter(F.col("delta") > eps).groupBy("v").agg(F.max_by(F.struct("src", "tgt", "delta"), rank).alias("b"))
    return best.select("v", "b.src", "b.tgt", "b.delta")


def together(proposals: DataFrame, g: Graph, objective, m, seed: int, turn: int, x: DataFrame | None = None, rows: int | None = None, eps: float = EPS) -> DataFrame:
    """The proposals of a round: a community either takes in any number of vertices or gives one away.

    Which of both its best proposal decides. Of those that join one community, in order of gain, the ones before the
    first that gains nothing after the others have joined; so all gains are exact, and the best of all is among them.
    The result is (v, src, tgt, delta, left), left being the gain after those before. rows: how many proposals there are.
    """
    x = partition.masses(g, objective) if x is None else x
    names = [c for c in x.columns if c != "v"]
    tie = F.xxhash64(F.col("v"), F.lit(seed), F.lit(turn))
    p = proposals.withColumn("rank", F.struct(F.col("delta").alias("d"), tie.alias("t"), "v"))
    sides = F.array(F.struct(F.col("src").alias("c"), F.lit(True).alias("gives")), F.struct(F.col("tgt").alias("c"), F.lit(False).alias("gives")))
    first = p.select("rank", F.explode(sides).alias("e")).filter("e.c is not null").groupBy("e.c").agg(F.max(F.struct("rank", "e.gives")).alias("top"))
    p = p.join(first.select(F.col("c").alias("src"), F.col("top.rank").alias("s")), "src").filter("rank = s")
    p = p.join(first.select(F.col("c").alias("tgt"), F.col("top.gives").alias("busy")), "tgt", "left").filter("tgt is null or not busy")
    p = p.select("v", "src", "tgt", "delta", "rank").join(x, "v")
    # a pair that joins the same community: its weight, less its product of masses
    join = p.filter("tgt is not null")
    other = join.select(F.col("v").alias("u"), F.col("tgt").alias("u_tgt"), F.col("rank").alias("u_rank"))
    among = g.edges_of(join).join(join.select("v", "tgt", "rank"), "v").join(other, "u").filter("tgt = u_tgt and u_rank > rank").groupBy("v").agg(F.sum("w").alias("w"))
    left = running(join, "tgt", "rank", {f"before_{k}": k for k in names}, rows).join(among, "v", "left")
    gain = F.col("delta") + objective.unit(m) * F.coalesce("w", F.lit(0.0))
    for k, price in zip(names, objective.prices(m), strict=True):
        gain = gain - price * F.col(k) * F.col(f"before_{k}")
    left = left.withColumn("left", gain)
    stop = left.filter(~(F.col("left") > eps)).groupBy("tgt").agg(F.max("rank").alias("stop"))
    good = left.join(stop, "tgt", "left").filter("stop is null or rank > stop")
    return good.select("v", "src", "tgt", "delta", "left").union(p.filter("tgt is null").select("v", "src", "tgt", "delta", F.col("delta").alias("left")))


class _State:
    """The assignment of a graph's vertices on the way, with the sums of its communities."""

    def __init__(self, g: Graph, assignment: DataFrame, objective):
        self.g, self.objective, self.m, self.eps = g, objective, g.totals(), tolerance(g)
        self.x = cut(partition.masses(g, objective))
        self.current = cut(assignment)
        self.com = cut(partition.community_masses(self.x, self.current))
        self.top = self.current.agg(F.coalesce(F.max("c"), F.lit(-1))).first()[0]
        self.rounds: list[dict] = []

    def apply(self, moved: DataFrame) -> None:
        """Make the moves (v, src, c)."""
        after, com = cut(partition.apply_moves(self.current, moved)), cut(partition.advance_masses(self.com, moved, self.x))
        drop(self.current, self.com)
        self.current, self.com = after, com

    def placed(self, taken: DataFrame, fresh: int) -> DataFrame:
        """(v, src, c) of the moves taken; those to an empty community get ids past all others."""
        to = taken.filter("tgt is not null").select("v", "src", F.col("tgt").alias("c"))
        if not fresh:
            return to
        new = ranked(taken.filter("tgt is null").select("v", "src"), "v", "place")
        top, self.top = self.top, self.top + fresh
        return cut(to.union(new.select("v", "src", (F.lit(top) + 1 + F.col("place")).cast("long"))))

    def frontier(self, moved: DataFrame, refused: DataFrame | None = None) -> tuple[DataFrame, int]:
        """(v) of what is to be looked at after the moves, and how many: neighbours outside the new community, and what was refused."""
        near = self.g.edges_of(moved).join(moved.select("v", F.col("c").alias("to")), "v").select(F.col("u").alias("v"), "to")
        near = near.join(self.current, "v").filter("not c <=> to").select("v")
        if refused is not None:
            near = near.union(refused.select("v"))
        seen = Observation()
        out = cut(near.distinct().observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    def note(self, **row) -> None:
        self.rounds.append({"turn": len(self.rounds)} | row)


def local_move(g: Graph, assignment: DataFrame, objective, seed: int = 0, interval: int = 1) -> Moved:
    """Rounds of best moves until a full sweep proposes none; every round gains, so that there is a last one.

    After a round only neighbours of what moved, and what was refused, are looked at; when they propose nothing, all
    vertices are. Every interval rounds are logged; the result has a row for each.
    """
    g = g.prepared()
    return _rounds(_State(g, assignment, objective), g.num_vertices(), seed, interval)


def _rounds(s: _State, n: int, seed: int, interval: int) -> Moved:
    frontier, looked = None, n
    for turn in count():
        began, made, kept = time.time(), Observation(), Observation()
        best = best_moves(candidates(s.g, s.current, s.objective, s.m, only=frontier, x=s.x, com=s.com), s.eps)
        proposals = cut(best.observe(made, F.count(F.lit(1)).alias("n")))
        k, fresh, gain = 0, 0, 0.0
        if made.get["n"]:
            good = together(proposals, s.g, s.objective, s.m, seed, turn, s.x, made.get["n"], s.eps)
            taken = cut(good.observe(kept, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("tgt").isNull(), 1)).alias("fresh"), F.sum("left").alias("gain")))
            k, fresh, gain = kept.get["n"], kept.get["fresh"], kept.get["gain"]
        if turn % interval == 0:
            log.info("round %d: %d moves", turn, k)
        done = {"way": "round", "looked_at": looked, "proposals": made.get["n"], "moves": k, "fresh": fresh, "gain": gain or 0.0}
        if not k:
            s.note(**done, seconds=time.time() - began)
            drop(proposals)
            if frontier is None:
                drop(s.x, s.com)
                return Moved(s.current, sum(r["moves"] for r in s.rounds), sum(r["looked_at"] for r in s.rounds), s.rounds)
            drop(frontier)
            frontier, looked = None, n
            continue
        moved = s.placed(taken, fresh)
        s.apply(moved)
        old = frontier
        refused = proposals.join(moved, "v", "left_anti")
        frontier, looked = s.frontier(moved, refused)
        s.note(**done, seconds=time.time() - began)
        drop(proposals, taken, moved, *([] if old is None else [old]))


@dataclass
class Arrays:
    """A graph in memory: neighbours of vertex i at first[i]:first[i + 1]; x has a row of masses for each vertex.

    Vertices from own on are others', which stay where they are and whose edges aren't held.
    """

    ids: np.ndarray
    x: np.ndarray
    first: np.ndarray
    to: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Arrays:
        """From edges (src, dst, w) by id, each once; ids ascend."""
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        off = a != b
        return cls.directed(ids, x, np.concatenate([a[off], b[off]]), np.concatenate([b[off], a[off]]), np.concatenate([w[off], w[off]]), len(ids))

    @classmethod
    def directed(cls, ids: np.ndarray, x: np.ndarray, frm: np.ndarray, to: np.ndarray, w: np.ndarray, own: int) -> Arrays:
        """From places of the ends of each edge, as seen from the first own vertices."""
        by = np.lexsort((to, frm))
        return cls(ids, np.asarray(x, float).reshape(len(ids), -1), np.searchsorted(frm[by], np.arange(own + 1)), to[by], w[by])

    def into(self, i: int, label) -> dict[int, float]:
        """Weight from i into each label among its neighbours."""
        out: dict[int, float] = {}
        for j, w in zip(self.to[self.first[i] : self.first[i + 1]].tolist(), self.w[self.first[i] : self.first[i + 1]].tolist(), strict=True):
            out[label[j]] = out.get(label[j], 0.0) + w
        return out


@dataclass(frozen=True)
class Form:
    """An objective's numbers in one graph, for kernels."""

    unit: float
    prices: tuple[float, ...]

    @classmethod
    def of(cls, objective, m) -> Form:
        return cls(objective.unit(m), tuple(objective.prices(totals(m))))

    def cost(self, a, b) -> float:
        """What two sets of masses cost that come together."""
        return sum(p * x * y for p, x, y in zip(self.prices, a, b, strict=True))


def queue_kernel(a: Arrays, label: np.ndarray, total: dict[int, tuple], size: dict[int, int], form: Form, fresh, seed: int, eps: float = EPS) -> tuple[list[int], int, int]:
    """(labels, moves, visits): queues over the vertices whose edges a holds, until none of them can gain.

    A move changes communities for others than neighbours too, so queues follow each other until one moves nothing.
    total and size: masses and members of each label, and are changed; fresh(i): an unused label for vertex i, or none.
    """
    n, masses, label = len(a.first) - 1, [tuple(r) for r in a.x.tolist()], label.tolist()
    rng, queue, queued = np.random.default_rng(seed), deque(), [False] * n
    moves, visits, before = 0, 0, -1
    minus = lambda p, q: tuple(i - j for i, j in zip(p, q, strict=True))
    plus = lambda p, q: tuple(i + j for i, j in zip(p, q, strict=True))
    while queue or moves > before:
        if not queue:
            before, queue, queued = moves, deque(rng.permutation(n).tolist()), [True] * n
            if not n:
                break
        v = queue.popleft()
        queued[v] = False
        visits += 1
        near, home, x = a.into(v, label), label[v], masses[v]
        # what staying is worth; a target's gain is what it is worth beyond that
        stay = form.unit * near.get(home, 0.0) - form.cost(x, minus(total[home], x))
        best, to = eps, home
        for c in sorted(near):
            if c != home and (d := form.unit * near[c] - form.cost(x, total[c]) - stay) > best:
                best, to = d, c
        if size[home] > 1 and -stay > best and (new := fresh(v)) is not None and not size.get(new):
            to = new
        if to == home:
            continue
        moves += 1
        label[v] = to
        size[home] -= 1
        total[home] = minus(total[home], x) if size[home] else (0.0,) * len(x)
        total[to] = plus(total.get(to, (0.0,) * len(x)), x)
        size[to] = size.get(to, 0) + 1
        for u in a.to[a.first[v] : a.first[v + 1]].tolist():
            if u < n and label[u] != to and not queued[u]:
                queued[u] = True
                queue.append(u)
    return label, moves, visits


def block_moves(s: _State, n_blocks: int, seed: int, turn: int) -> DataFrame:
    """(v, src, c, visits) of what queues do in each block of vertices, side by side; visits is the block's, in one row of it.

    A community is one block's unless it is larger than a block; other blocks' vertices are seen as they are now.
    Vertices of more than HUB edges stay. A new community's id is that of its first vertex, past all others.
    """
    ship(s.current.sparkSession)
    g, form, eps, k = s.g, Form.of(s.objective, s.m), s.eps, len(s.objective.prices(s.m))
    names = [f"x{i}" for i in range(k)]
    low = g.nodes.agg(F.coalesce(F.min("v"), F.lit(0))).first()[0]
    base = s.top + 1 - low
    large = F.col("n_members") > g.nodes.count() / max(1, n_blocks) + 1
    spot = F.when(large, F.xxhash64("v", F.lit(seed), F.lit(turn))).otherwise(F.xxhash64("c", F.lit(seed + 1), F.lit(turn)))
    at = s.current.join(s.com, "c").select("v", "c", "n_members", F.pmod(spot, F.lit(n_blocks)).cast("int").alias("block"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(names)])
    at = cut(at.join(s.x, "v"))
    few = g.sym().groupBy("v").count().filter(F.col("count") <= HUB).select("v")
    own = at.join(few, "v", "left_semi")
    other = at.select(F.col("v").alias("u"), F.col("c").alias("cu"), F.col("n_members").alias("nu"), *[F.col(f"t{i}").alias(f"tu{i}") for i in range(k)])
    # an edge brings what its far end's community is
    e = g.sym().join(own.select("v", "block"), "v").join(other, "u")
    wide = lambda *kinds: [F.col(f"{c}{i}") if c else F.lit(0.0) for c in kinds for i in range(k)]
    sums = [f"{c}{i}" for c in "tx" for i in range(k)]
    rows = own.select("block", F.lit(0).alias("kind"), F.col("v").alias("a"), F.col("c").alias("b"), F.col("c"), F.lit(0.0).alias("w"), F.col("n_members").alias("n"), *[c.alias(n) for c, n in zip(wide("t", "x"), sums, strict=True)])
    rows = rows.union(e.select("block", F.lit(1), "v", "u", "cu", "w", "nu", *wide("tu", "")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, edges = pdf[pdf["kind"] == 0].sort_values("a"), pdf[pdf["kind"] == 1]
        edges = edges.sort_values(["a", "b"])
        ids, block = mine["a"].to_numpy(), int(pdf["block"].iloc[0])
        far = np.setdiff1d(edges["b"].to_numpy(), ids)
        every = np.concatenate([ids, far])
        order = np.argsort(every, kind="stable")
        place = lambda v: order[np.searchsorted(every[order], v)]
        label = np.zeros(len(every), np.int64)
        label[place(edges["b"].to_numpy())] = edges["c"].to_numpy()
        label[: len(ids)] = mine["b"].to_numpy()
        total, size = {}, {}
        for part in (edges.drop_duplicates("c"), mine.drop_duplicates("c")):
            for c, m, t in zip(part["c"].tolist(), part["n"].tolist(), part[sums[:k]].to_numpy(float).tolist(), strict=True):
                total[c], size[c] = tuple(t), int(m)
        x = np.zeros((len(every), k))
        x[: len(ids)] = mine[sums[k:]].to_numpy(float)
        a = Arrays.directed(every, x, place(edges["a"].to_numpy()), place(edges["b"].to_numpy()), edges["w"].to_numpy(float), len(ids))
        got, _, visits = queue_kernel(a, label, total, size, form, lambda i: base + int(ids[i]), (seed * 1_000_003 + turn * 7919 + block) & (1 << 63) - 1, eps)
        out = pd.DataFrame({"v": ids, "src": label[: len(ids)], "c": np.array(got[: len(ids)], np.int64), "visits": 0})
        out.loc[:0, "visits"] = visits
        return out[(out["src"] != out["c"]) | (out["visits"] > 0)]

    return rows.groupBy("block").applyInPandas(run, "v long, src long, c long, visits long")


def joint_gain(s: _State, moved: DataFrame) -> float:
    """The exact change of quality by moves (v, src, c) made together; only the edges of what moves are read."""
    at = s.current.select(F.col("v").alias("u"), F.col("c").alias("cu"))
    e = s.g.edges_of(moved).join(moved.select("v", "src", "c"), "v").join(at, "u").join(moved.select(F.col("v").alias("u"), F.col("c").alias("cv")), "u", "left")
    w = F.col("w") * F.when(F.col("cv").isNull(), 1.0).otherwise(0.5)
    weight = e.select((F.when(F.coalesce("cv", "cu") == F.col("c"), w).otherwise(0.0) - F.when(F.col("cu") == F.col("src"), w).otherwise(0.0)).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
    names = [c for c in s.x.columns if c != "v"]
    m = moved.join(s.x, "v")
    change = m.select(F.col("src").alias("c"), *[(-F.col(k)).alias(k) for k in names]).union(m.select("c", *names)).groupBy("c").agg(*[F.sum(k).alias(f"d_{k}") for k in names])
    both = change.join(s.com, "c", "left").fillna(0.0, names)
    squares = both.agg(*[F.coalesce(F.sum(F.col(f"d_{k}") * (2 * F.col(k) + F.col(f"d_{k}"))), F.lit(0.0)) for k in names]).first()
    return s.objective.unit(s.m) * weight - sum(p * d / 2 for p, d in zip(s.objective.prices(s.m), squares, strict=True))


def local_move_queue(g: Graph, assignment: DataFrame, objective, seed: int = 0, block_rows: int = BLOCK_ROWS, interval: int = 1) -> Moved:
    """Queues over blocks of about block_rows rows of the adjacency, then rounds as in `local_move`.

    What the blocks do is made when it gains together, exactly; blocks are dealt anew each time, with the communities
    that there are. When it gains no more than a ten-thousandth of what the first time gained, rounds go on. A graph of
    one block is worked through by a single queue.
    """
    g = g.prepared()
    s, n = _State(g, assignment, objective), g.num_vertices()
    blocks, first = max(1, -(-2 * g.num_edges() // block_rows)), None
    for turn in count():
        began, seen = time.time(), Observation()
        out = cut(block_moves(s, blocks, seed, turn).observe(seen, F.count(F.when(F.col("src") != F.col("c"), 1)).alias("n"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits")))
        moved, k = out.filter("src <> c").select("v", "src", "c"), seen.get["n"]
        gain = joint_gain(s, moved) if k else 0.0
        taken = k and gain > s.eps
        if taken:
            s.apply(moved)
            s.top = max(s.top, s.current.agg(F.max("c")).first()[0])
        log.info("queues %d: %d moves", turn, k if taken else 0)
        s.note(way="queue", looked_at=seen.get["visits"], proposals=k, moves=k if taken else 0, fresh=0, gain=gain if taken else 0.0, seconds=time.time() - began)
        drop(out)
        first = gain if first is None else first
        if not taken or gain <= 1e-4 * first or blocks == 1:
            return _rounds(s, n, seed, interval)
