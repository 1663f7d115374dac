"""Objectives through all phases, incremental sums, blocks, refinement by rounds, stretches of colouring, kept levels."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockgraph.functions.quality import ConstantPotts, ErdosRenyi, Modularity, Objective, SignedModularity
from blockgraph.graph import Graph
from blockgraph.operators import coloring, moves, partition, refine
from blockgraph.plans.cluster import Options, cluster
from blockgraph.runtime import cut, running


def graph(spark, edges, n, sizes=None):
    nodes = spark.createDataFrame([(v, 1.0 if sizes is None else sizes[v]) for v in range(n)], "v long, node_size double")
    return Graph.from_edges(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, w double"), w="w", nodes=nodes).persist()


def labels(spark, c):
    return spark.createDataFrame(list(enumerate(c)), "v long, c long")


def by_vertex(df, *cols):
    return {r[0]: r[1] if len(cols) == 1 else tuple(r)[1:] for r in df.select("v", *cols).collect()}


class ByRoot(Objective):
    """One of a user's own: masses are roots of strengths."""

    def masses(self):
        return (F.sqrt("strength"),)

    def prices(self, m):
        return (0.2,)


def worth(objective, edges, n, sizes, c):
    """Quality by the definitions, with every pair looked at."""
    inner = sum(w for a, b, w in edges if c[a] == c[b])
    ends = lambda keep: [sum(abs(w) * ((a == v) + (b == v)) for a, b, w in edges if keep(w)) for v in range(n)]
    square = lambda x: sum(sum(x[v] for v in range(n) if c[v] == k) ** 2 for k in set(c))
    m, strength = sum(w for *_, w in edges), [sum(w * ((a == v) + (b == v)) for a, b, w in edges) for v in range(n)]
    pairs = (square(sizes) - sum(sizes)) / 2
    if isinstance(objective, ConstantPotts):
        return inner - objective.gamma * pairs
    if isinstance(objective, ErdosRenyi):
        return inner - objective.gamma * pairs * m / (sum(sizes) * (sum(sizes) - 1) / 2)
    if isinstance(objective, Modularity):
        return 2 * inner - objective.gamma * square(strength) / (2 * m)
    if isinstance(objective, ByRoot):
        return inner - 0.2 * square([math.sqrt(x) for x in strength]) / 2
    above, below = sum(w for *_, w in edges if w > 0), -sum(w for *_, w in edges if w < 0)
    return 2 * inner - objective.gamma * square(ends(lambda w: w > 0)) / (2 * above) + objective.gamma_below * square(ends(lambda w: w < 0)) / (2 * below)


EDGES = [(0, 1, 2), (0, 2, 1), (1, 2, 2.5), (1, 2, 1), (3, 4, 3), (4, 5, 2), (3, 5, 2.5), (2, 3, 0.5), (0, 0, 2), (5, 6, 1.5), (6, 7, 3), (5, 7, 1), (7, 7, 1)]
SIGNED = [(0, 1, 2), (0, 2, 1), (1, 2, 2.5), (3, 4, 3), (4, 5, 2), (3, 5, 2.5), (2, 3, -2), (1, 4, -1), (5, 6, 1.5), (6, 7, 3), (0, 7, -2.5)]
SIZES = [2.0, 1.0, 3.0, 1.0, 2.0, 1.0, 1.0, 2.0]
CASES = [(ConstantPotts(0.35), EDGES), (Modularity(0.8), EDGES), (ErdosRenyi(1.1), EDGES), (SignedModularity(1.0, 0.9), SIGNED), (ByRoot(), EDGES)]


@pytest.mark.parametrize(("objective", "edges"), CASES)
def test_every_move_of_every_objective(spark, objective, edges):
    """All vertices and targets, a new community among them: delta is the change of quality."""
    g, c = graph(spark, edges, 8, SIZES), [0, 0, 1, 1, 1, 2, 2, 0]
    at = labels(spark, c)
    assert partition.quality(g, at, objective) == pytest.approx(worth(objective, edges, 8, SIZES, c), abs=1e-10)
    # every community is next to every vertex by an edge of no weight
    near = [(v, u, 0.0) for v in range(8) for u in range(v) if not any({a, b} == {v, u} for a, b, _ in edges)]
    found = moves.candidates(graph(spark, edges + near, 8, SIZES), at, objective).collect()
    assert len(found) == 8 * 3
    before = worth(objective, edges, 8, SIZES, c)
    for r in found:
        new = [(9 if r["tgt"] is None else r["tgt"]) if v == r["v"] else k for v, k in enumerate(c)]
        assert r["delta"] == pytest.approx(worth(objective, edges, 8, SIZES, new) - before, abs=1e-10)


def partitions(n):
    def grow(c):
        if len(c) == n:
            yield c
        else:
            for k in range(max(c, default=-1) + 2):
                yield from grow([*c, k])

    return grow([])


@pytest.mark.parametrize(("objective", "edges"), [(ErdosRenyi(1.0), EDGES), (SignedModularity(), SIGNED), (ByRoot(), EDGES)])
def test_clusters_against_the_optimum(spark, objective, edges):
    ones = [1.0] * 8
    best = max(worth(objective, edges, 8, ones, c) for c in partitions(8))
    g = graph(spark, edges, 8)
    found = cluster(g, objective, Options(seed=4))
    c = by_vertex(found.assignment, "c")
    got = worth(objective, edges, 8, ones, [c[v] for v in range(8)])
    assert got == pytest.approx(partition.quality(g, found.assignment, objective), abs=1e-9)
    assert best - 0.05 * abs(best) <= got <= best + 1e-9
    assert not moves.best_moves(moves.candidates(found.last, found.last_assignment, objective, g.totals()), 1e-9).count()


def test_community_sums_by_what_moved(spark):
    rng = random.Random(4)
    edges = [(i, j, rng.choice((1, 2.5, 4))) for i in range(30) for j in range(i + 1) if rng.random() < 0.2]
    g, c = graph(spark, edges, 30).prepared(), [v % 5 for v in range(30)]
    com = cut(partition.communities(g, labels(spark, c)))
    x = cut(partition.masses(g, Modularity(1.0)))
    sums = cut(partition.community_masses(x, labels(spark, c)))
    for _ in range(3):
        new = {v: rng.randrange(9) for v in rng.sample(range(30), 9)}
        old, c = labels(spark, c), [new.get(v, k) for v, k in enumerate(c)]
        step = spark.createDataFrame(list(new.items()), "v long, c long")
        com = cut(partition.advance_communities(g, com, old, step))
        sums = cut(partition.advance_masses(sums, old.withColumnRenamed("c", "src").join(step, "v"), x))
        want = partition.communities(g, labels(spark, c))
        key = lambda df: sorted((r["c"], r["n_members"], *(round(r[k], 9) for k in df.columns if k not in ("c", "n_members"))) for r in df.collect())
        assert key(com.select(*want.columns)) == key(want)
        assert key(sums) == key(partition.community_masses(x, labels(spark, c)))


def test_refined_sums_by_what_moved(spark):
    g = graph(spark, [(0, 0, 10), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 2, 0.25), (2, 3, 0.5)], 5).prepared()
    parent, refined = labels(spark, [0, 0, 0, 0, 1]), labels(spark, [0, 0, 1, 2, 3])
    stats = refine.refinement_stats(g, parent, refined, ConstantPotts(0.2))
    for step in ([(0, 1)], [(0, 1), (1, 2), (3, 1)]):
        after = refine.advance_refinement(g, stats, parent, refined, spark.createDataFrame(step, "v long, c long"), ConstantPotts(0.2))
        want = refine.refinement_stats(g, parent, partition.apply_moves(refined, spark.createDataFrame(step, "v long, c long")), ConstantPotts(0.2))
        assert sorted(map(tuple, after.collect())) == sorted(map(tuple, want.select(*after.columns).collect()))
    one = refine.advance_refinement(g, stats, parent, refined, spark.createDataFrame([(0, 1)], "v long, c long"), ConstantPotts(0.2)).filter("parent = 0")
    assert sorted(map(tuple, one.drop("parent").collect())) == [(0, 1, 1.0, 1.25), (1, 2, 2.0, 4.75), (2, 1, 1.0, 3.5)]


@pytest.mark.parametrize(("objective", "signed"), [(ConstantPotts(0.05), False), (SignedModularity(), True)])
def test_refinement_of_one_community_by_rounds(spark, objective, signed):
    rng = random.Random(8)
    groups = [range(k, k + 6) for k in range(0, 24, 6)]
    edges = [(i, j, 1.0) for own in groups for i in own for j in own if i < j] + [(rng.randrange(24), rng.randrange(24), 1.0) for _ in range(12)]
    edges += [(i, (i + 7) % 24, -1.0) for i in range(0, 24, 3)] if signed else []
    # a leaf each: nothing is as often joined as a hub
    edges += [(0, v, 1.0) for v in range(24, 40)]
    g = graph(spark, edges, 41)
    parent = labels(spark, [0] * 24 + [0] * 12 + [1] * 5)
    m = g.totals()
    x = partition.masses(g, objective).join(parent.withColumnRenamed("c", "p"), "v")
    inner = partition.inside(g, parent).filter("cu = cv and src <> dst")
    both = inner.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").union(inner.select("dst", "src", "w"))
    found, com = refine.refine_rounds(x, both, objective, m, 0.01, 5)
    got = by_vertex(found, "c")
    again = refine.refine(Graph(g.nodes.repartition(6), g.edges.repartition(8)), parent, objective, 0.01, 5, task_edges=0)
    assert by_vertex(again, "c") == got
    # parts of one parent each, named after a member, connected and better than their vertices alone
    p = by_vertex(parent, "c")
    assert set(got) == set(p) and all(p[v] == p[c] and got[c] == c for v, c in got.items())
    assert len(set(got.values())) < 41
    assert partition.quality(g, found, objective) > partition.quality(g, partition.singletons(g), objective)
    for c in set(got.values()):
        mine = {v for v in got if got[v] == c}
        seen = [c]
        for v in seen:
            seen += {b if a == v else a for a, b, _ in edges if v in (a, b)} & mine - set(seen)
        assert set(seen) == mine
    # the sums that were kept on the way are those of the result
    stats = refine.refinement_stats(g, parent, found, objective)
    key = lambda df, *cols: sorted((r["c"], *(round(r[k], 9) for k in cols)) for r in df.collect())
    assert key(com, "n", "x0", "ext") == key(stats, "n_members", "mass", "external_w")


def test_blocks_of_the_queue(spark):
    rng = random.Random(2)
    edges = [(i, j, 1.0) for i in range(60) for j in range(i) if rng.random() < (0.5 if i // 12 == j // 12 else 0.03)]
    g = graph(spark, edges, 60).prepared()
    found = moves.local_move_queue(g, partition.singletons(g), Modularity(1.0), 3, block_rows=len(edges) // 2)
    assert not moves.best_moves(moves.candidates(g, found.assignment, Modularity(1.0)), 1e-9).count()
    steps = [r["gain"] for r in found.rounds]
    start, end = (partition.quality(g, a, Modularity(1.0)) for a in (partition.singletons(g), found.assignment))
    # the gains that were found on the way are exact
    assert sum(steps) == pytest.approx(end - start) and min(steps) >= 0 and found.moves == sum(r["moves"] for r in found.rounds)
    whole = moves.local_move_queue(g, partition.singletons(g), Modularity(1.0), 3)
    assert end >= 0.9 * partition.quality(g, whole.assignment, Modularity(1.0))
    table = moves.profile(spark, [found.rounds, whole.rounds])
    assert table.count() == len(found.rounds) + len(whole.rounds) and table.filter("level = 1").agg(F.sum("moves")).first()[0] == found.moves


def test_a_round_reads_its_vertices_edges(spark, monkeypatch):
    from blockgraph import graph as module

    monkeypatch.setattr(module, "PART_ROWS", 40)
    g = graph(spark, [(v, v + 1, 1.0) for v in range(400)], 401).prepared()
    assert g.parts == 20
    few = spark.createDataFrame([(7,), (8,)], "v long")
    plan = g.edges_of(few)._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(map(tuple, g.edges_of(few).collect())) == [(7, 6, 1.0), (7, 8, 1.0), (8, 7, 1.0), (8, 9, 1.0)]
    assert len({r["f"] for r in g.edges_of(few).select(F.input_file_name().alias("f")).collect()}) <= 2
    # the edges are restricted before they are summed
    cand = moves.candidates(g, partition.singletons(g), Modularity(1.0), only=few)
    lines = cand._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: min(len(x) - len(x.lstrip(" :+-")) for x in lines if word in x)
    assert depth("Join LeftSemi") > depth("Aggregate [v")
    assert {r["v"] for r in cand.collect()} == {7, 8}


def test_running_sums_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, float(rng.randrange(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o int, x double").repartition(5)
    want = {o: sum(y for j, p, y in rows if j == k and p > o) for k, o, _ in rows}
    for limit in (10**6, 0):
        import blockgraph.runtime as runtime

        old, runtime.WINDOW_ROWS = runtime.WINDOW_ROWS, limit
        try:
            assert {r["o"]: r["before"] for r in running(df, "k", "o", {"before": "x"}).collect()} == want
        finally:
            runtime.WINDOW_ROWS = old


def test_a_path_costs_few_rounds(spark, monkeypatch):
    n, made = 100_000, []
    g = Graph.from_edges(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    monkeypatch.setattr(coloring, "cut", lambda *a, **k: made.append(1) or cut(*a, **k))
    got = coloring.greedy(g, 50_000)
    want = {}
    for v in [*range(1, n - 1), 0, n - 1]:
        want[v] = min({0, 1, 2} - {want.get(v - 1), want.get(v + 1)})
    assert dict(got.toPandas().itertuples(index=False)) == want
    assert len(made) < 20


def test_kept_levels_go_on(spark, tmp_path):
    rng = random.Random(3)
    edges = [(i, j, 1.0) for i in range(24) for j in range(i) if rng.random() < (0.8 if i // 4 == j // 4 else 0.3 if i // 12 == j // 12 else 0.03)]
    g = graph(spark, edges, 24)
    whole = cluster(g, Modularity(1.0), Options(seed=5))
    assert whole.levels > 1
    at = str(tmp_path / "levels")
    first = cluster(g, Modularity(1.0), Options(seed=5, keep=at))
    # as if the driver had been lost after the first level
    import shutil

    for k in range(2, first.levels + 1):
        shutil.rmtree(f"{at}/level-{k}", ignore_errors=True)
    again = cluster(g, Modularity(1.0), Options(seed=5, keep=at))
    assert by_vertex(again.assignment, "c") == by_vertex(whole.assignment, "c") == by_vertex(first.assignment, "c")
    assert (again.levels, again.moves) == (whole.levels, whole.moves)
    with pytest.raises(ValueError):
        cluster(g, Modularity(2.0), Options(seed=5, keep=at))


def test_scan_of_edges(spark):
    def heavy(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([float(sum(b.column(2).to_pylist()))])], ["n", "w"])

    g = graph(spark, EDGES, 8)
    got = g.scan_edges(heavy, "n long, w double").agg(F.sum("n"), F.sum("w")).first()
    assert tuple(got) == (len(EDGES), sum(w for *_, w in EDGES))


def test_vertices_of_no_mass_join_any_part_alike_and_in_linear_time():
    form = moves.Form(2.0, (0.5,))
    none = np.zeros(0, np.int64)
    alone = lambda n: moves.Arrays.of(np.arange(n), np.zeros((n, 1)), none, none, np.zeros(0))

    def outcomes(label, todo):
        """(parts, chance) of every way to go on: who is alone draws among all parts."""
        if not todo:
            yield len(set(label)), 1.0
            return
        v = todo[0]
        to = sorted(set(label)) if label.count(label[v]) == 1 else [label[v]]
        for c in to:
            for k, p in outcomes([c if i == v else x for i, x in enumerate(label)], todo[1:]):
                yield k, p / len(to)

    want = dict.fromkeys(range(1, 5), 0.0)
    for k, p in outcomes(list(range(4)), list(range(4))):
        want[k] += p
    got = [len(set(refine.refine_kernel(alone(4), form, 0.01, seed).tolist())) for seed in range(3000)]
    for k, p in want.items():
        assert abs(got.count(k) / 3000 - p) < 0.04
    began = time.time()
    assert len(set(refine.refine_kernel(alone(20_000), form, 0.01, 1).tolist())) < 20_000
    # before, each of them looked at all parts: 9 s for 1500
    assert time.time() - began < 60
