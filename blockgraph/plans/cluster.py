"""Clustering on several levels: local moving, refinement, contraction, again until nothing moves."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field
from itertools import count
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import coloring, contract, moves, partition, refine
from ..runtime import cut, exists, few_broadcasts

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    theta: float = 0.01
    seed: int = 0
    #: 0: no limit
    max_levels: int = 0
    #: "queue": first by queues over blocks of vertices, side by side, then in rounds; "rounds": in rounds only
    way: Literal["queue", "rounds"] = "queue"
    #: rounds of local moving between lines of the log
    debug_interval: int = 1
    #: folder that keeps each finished level, so that a run that was cut off goes on after the last one
    keep: str | None = None

    def __post_init__(self):
        if not self.theta > 0 or self.max_levels < 0 or not self.debug_interval > 0:
            raise ValueError("theta and debug_interval must be positive and max_levels not negative")
        if self.way not in ("rounds", "queue"):
            raise ValueError(f"no way of local moving: {self.way}")


@dataclass
class Clustering:
    assignment: DataFrame
    levels: int
    moves: int
    #: seconds by phase, a dict for each level
    seconds: list[dict[str, float]] = field(default_factory=list)
    #: rounds of local moving, a list for each level; `moves.profile` makes a table of them
    rounds: list[list[dict]] = field(default_factory=list)
    #: the last level's graph and its vertices' communities
    last: Graph | None = None
    last_assignment: DataFrame | None = None


def _keep(at: str, depth: int, level: Graph, current: DataFrame, place: DataFrame, state: dict) -> None:
    """A finished level's tables, then its state: a level without one is as if it weren't there."""
    spark, path = level.nodes.sparkSession, f"{at}/level-{depth}"
    for name, df in (("nodes", level.nodes), ("edges", level.edges), ("current", current), ("place", place)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    # one row: the marker that the level is whole
    spark.createDataFrame([(depth, json.dumps(state))], "depth int, state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def _kept(spark: SparkSession, at: str, state: dict) -> tuple[int, Graph, DataFrame, DataFrame, dict] | None:
    """(depth, level, current, place, state) of the last whole level at a folder. :raises ValueError: if it is of another run."""
    found = None
    for depth in count(1):
        if not exists(spark, f"{at}/level-{depth}/state/_SUCCESS"):
            break
        found = depth
    if found is None:
        return None
    read = lambda name: spark.read.parquet(f"{at}/level-{found}/{name}")
    was = json.loads(read("state").first()["state"])
    if was["of"] != state["of"]:
        raise ValueError(f"{at} holds levels of another clustering: {was['of']}, not {state['of']}")
    return found, Graph(read("nodes"), read("edges")), read("current"), read("place"), was


def cluster(g: Graph, objective, options: Options = Options()) -> Clustering:
    """A partition that no single move improves on its last level, with ids 0, 1, ...

    levels counts local-moving phases; an empty graph has none, one that converges at once has 1. With max_levels
    the result is the local-moving partition of the last level. With options.keep each level is kept when it is done,
    and a new call with the same graph and options goes on after the last one, to the same result.
    """
    with few_broadcasts(g.nodes.sparkSession):
        return _cluster(g.persist(), objective, options)


def _cluster(g: Graph, objective, options: Options) -> Clustering:
    n = g.num_vertices()
    if not n:
        return Clustering(g.nodes.select("v", F.col("v").alias("c")), 0, 0)
    level, place, current, total, seconds, rounds, done = g, None, partition.singletons(g), 0, [], [], 0
    spark = g.nodes.sparkSession
    run = {"of": [repr(objective), options.theta, options.seed, options.way, n, g.num_edges(), g.total_weight()]}
    if options.keep and (was := _kept(spark, options.keep, run)):
        done, level, current, place, state = was
        total, seconds, rounds = state["moves"], state["seconds"], state["rounds"]
        log.info("going on after level %d", done)
    depth = done
    # with max_levels, the partition of the level before is there already
    while not (options.max_levels and depth >= options.max_levels):
        depth += 1
        took, began = {}, time.time()
        level = level.prepared()
        move = moves.local_move_queue if options.way == "queue" else moves.local_move
        moved = move(level, current, objective, options.seed + depth, interval=options.debug_interval)
        total += moved.moves
        current = moved.assignment
        rounds.append(moved.rounds)
        took["move"] = time.time() - began
        seconds.append(took)
        log.info("level %d: %d moves", depth, moved.moves)
        if not moved.moves or depth == options.max_levels:
            break
        began = time.time()
        refined = cut(refine.refine(level, current, objective, options.theta, options.seed + depth))
        took["refine"] = time.time() - began
        began = time.time()
        small = contract.aggregate_graph(level, refined, check=False)
        coarse_of = cut(small.coarse_of)
        current = cut(contract.coarse_partition(coarse_of, current))
        level = small.graph.persist()
        place = coarse_of if place is None else cut(contract.flatten(place, coarse_of))
        took["contract"] = time.time() - began
        if options.keep:
            _keep(options.keep, depth, level, current, place, run | {"moves": total, "seconds": seconds, "rounds": rounds})
    if place is None:
        final = current
    else:
        final = place.join(current.select(F.col("v").alias("coarse"), "c"), "coarse").select("v", "c")
    return Clustering(cut(partition.compact(final, check=False)), depth, total, seconds, rounds, level, current)


@dataclass
class Blocks:
    clustering: Clustering
    block_graph: Graph
    colors: DataFrame
    n_blocks: int
    n_colors: int
    #: seconds by phase
    seconds: dict[str, float] = field(default_factory=dict)


def blocks_and_colors(g: Graph, objective, options: Options = Options(), binary: bool = True) -> Blocks:
    """Cluster (with every weight 1, by default), contract to the block graph and colour it, the largest class first.

    :raises ValueError: if the colouring isn't valid
    """
    g = g.binary() if binary else g
    began, took = time.time(), {}

    def lap(name: str) -> None:
        nonlocal began
        took[name], began = time.time() - began, time.time()

    found = cluster(g, objective, options)
    lap("cluster")
    n = partition.id_bound(found.assignment).first()[0]
    bg = contract.block_graph(g, found.assignment, "binary", n).persist()
    lap("block_graph")
    colors = cut(coloring.relabel_by_size(coloring.greedy(bg)))
    lap("color")
    k = colors.agg(F.coalesce(F.max("color") + 1, F.lit(0))).first()[0]
    bad = coloring.violations(bg, colors, k).filter("n > 0").collect()
    lap("check")
    if bad:
        raise ValueError(f"not a colouring: {bad}")
    return Blocks(found, bg, colors, n, k, took)
