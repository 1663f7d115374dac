"""Command line: `cluster MATRIX RESOLUTION` writes blocks and colours, `evaluate MATRIX BLOCKS COLORS` reports on them."""

from __future__ import annotations

import argparse
import logging
import math
import re
import time

from pyspark.sql import SparkSession

from .functions.quality import ConstantPotts, Modularity, normalised
from .operators import evaluate, partition
from .plans.cluster import Options, blocks_and_colors
from .sources import files

METHODS = {"potts": ConstantPotts, "modularity": Modularity}


def resolution(text: str) -> str:
    """The text, if it is a finite positive number of safe characters."""
    try:
        ok = re.fullmatch(r"[0-9A-Za-z._+-]+", text) and 0 < float(text) < math.inf
    except ValueError:
        ok = False
    if not ok:
        raise argparse.ArgumentTypeError("a finite positive number is needed")
    return text


def positive(text: str) -> int:
    if not re.fullmatch(r"\d+", text) or int(text) < 1:
        raise argparse.ArgumentTypeError("a positive whole number is needed")
    return int(text)


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="blockgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster")
    c.add_argument("matrix")
    c.add_argument("resolution", type=resolution)
    c.add_argument("--method", choices=METHODS, default="potts")
    c.add_argument("--out", default=".")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--way", choices=("queue", "rounds"), default="queue")
    c.add_argument("--debug", action="store_true")
    c.add_argument("--debug-interval", type=positive, default=1)
    e = sub.add_parser("evaluate")
    for x in ("matrix", "blocks", "colors"):
        e.add_argument(x)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "cluster":
        return _cluster(spark, a)
    g = files.read_matrix(spark, a.matrix).persist()
    nb, blocks = files.read_blocks(spark, a.blocks, g.num_vertices())
    nc, colors = files.read_colors(spark, a.colors, nb)
    row = evaluate.report(g, blocks, nb, colors, nc).first()
    print(evaluate.text(row))
    unset = evaluate.valid(blocks, nb).filter("c is null").count() + colors.filter(f"color is null or color < 0 or color >= {nc}").count()
    if unset:
        raise SystemExit(f"{unset} nodes or blocks without a valid block or colour")
    return row.asDict()


def _cluster(spark: SparkSession, a) -> dict:
    if a.debug:
        logging.basicConfig(level=logging.INFO)
    g = files.read_matrix(spark, a.matrix).persist()
    objective = METHODS[a.method](float(a.resolution))
    began = time.time()
    found = blocks_and_colors(g, objective, Options(seed=a.seed, way=a.way, debug_interval=a.debug_interval))
    took = time.time() - began
    name = lambda kind: f"{a.out.rstrip('/')}/{files.output_name(a.matrix, a.method, a.resolution, kind)}"
    files.write_blocks(found.clustering.assignment, name("blk"))
    files.write_colors(found.colors, found.n_colors, name("bcol"))
    h, m = partition.quality(g.binary(), found.clustering.assignment, objective), float(g.num_edges())
    by_phase = {phase: sum(level.get(phase, 0.0) for level in found.clustering.seconds) for phase in ("move", "refine", "contract")}
    summary = {"matrix": a.matrix, "method": a.method, "resolution": a.resolution, "seed": a.seed, "vertices": g.num_vertices(), "edges": g.num_edges(), "blocks": found.n_blocks, "block_graph_edges": found.block_graph.num_edges(), "colors": found.n_colors, "levels": found.clustering.levels, "moves": found.clustering.moves, "quality": h}
    summary |= {"modularity": normalised(h, m)} if a.method == "modularity" else {}
    summary |= {f"{k}_seconds": v for k, v in {**by_phase, **found.seconds}.items()} | {"seconds": took, "blocks_file": name("blk"), "colors_file": name("bcol")}
    print("\n".join(f"{k}: {v}" for k, v in summary.items()))
    return summary


if __name__ == "__main__":
    main()
