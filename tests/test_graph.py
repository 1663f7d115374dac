"""Small graphs with known values."""

import itertools
import random

import pytest

from blockgraph.functions.quality import ConstantPotts, Modularity
from blockgraph.graph import Graph
from blockgraph.operators import coloring, contract, evaluate, moves, partition, refine
from blockgraph.plans.cluster import Options, cluster

TRIANGLES = "0-1 1-2 2-0 2-3 3-4 4-5 5-3"
LOOPS = "0-0:2 0-1:1.5 1-2:0.5 2-2:3 2-3:2.5"
PAIRS = "0-1:10 2-3:10 0-2:1.5 0-3:1.5 1-2:1.5 1-3:1.5"


def graph(spark, text, n):
    rows = [(*map(int, x.partition(":")[0].split("-")), float(x.partition(":")[2] or 1)) for x in text.split()]
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, w double"), w="w", nodes=spark.range(n).withColumnRenamed("id", "v"))


def labels(spark, *c):
    return spark.createDataFrame(list(enumerate(c)), "v long, c long")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stats_with_self_loops(spark):
    g = graph(spark, LOOPS, 4)
    assert g.total_weight() == 9.5
    assert dict(rows(g.strengths(), "v", "strength"))[0] == 5.5 and dict(rows(g.strengths(), "v", "strength"))[2] == 9
    com = rows(partition.communities(g, labels(spark, 0, 0, 1, 1)), "c", "internal_w")
    assert com == [(0, 3.5), (1, 5.5)]


def test_delta_is_the_change_of_quality(spark):
    g = graph(spark, LOOPS, 4).persist()
    a = labels(spark, 0, 0, 1, 1)
    for objective in (ConstantPotts(0.2), Modularity(1.2)):
        before = partition.quality(g, a, objective)
        for r in moves.candidates(g, a, objective).collect():
            to = 9 if r["tgt"] is None else r["tgt"]
            after = partition.quality(g, partition.apply_moves(a, spark.createDataFrame([(r["v"], to)], "v long, c long")), objective)
            assert after - before == pytest.approx(r["delta"], abs=1e-10)


@pytest.mark.parametrize("way", [moves.local_move, moves.local_move_queue])
def test_local_moving_ends_in_an_optimum(spark, way):
    g = graph(spark, TRIANGLES, 6).persist()
    found = way(g, partition.singletons(g), Modularity(1.0))
    assert found.moves and not moves.best_moves(moves.candidates(g, found.assignment, Modularity(1.0))).count()
    blocks = {tuple(r["members"]) for r in partition.members(found.assignment).collect()}
    assert blocks == {(0, 1, 2), (3, 4, 5)}


@pytest.mark.parametrize("objective", [Modularity(1.0), ConstantPotts(0.02)])
def test_a_community_takes_in_many_vertices_in_a_round(spark, objective):
    leaves, pairs = 40, 5
    text = " ".join([f"0-{i}" for i in range(1, leaves + 1)] + [f"{i}-{i + 1}" for i in range(leaves + 1, leaves + 2 * pairs, 2)])
    n = leaves + 1 + 2 * pairs
    g = graph(spark, text, n).persist()
    found = moves.local_move(g, partition.singletons(g), objective)
    assert found.visits <= 6 * n and not moves.best_moves(moves.candidates(g, found.assignment, objective)).count()
    assert sorted(len(r["members"]) for r in partition.members(found.assignment).collect()) == [2] * pairs + [leaves + 1]


@pytest.mark.parametrize("objective", [Modularity(1.2), ConstantPotts(0.3)])
def test_gains_of_a_round_are_exact_together(spark, objective):
    rng = random.Random(5)
    text = " ".join(f"{i}-{j}:{rng.choice((1, 2.5, 4))}" for i in range(24) for j in range(i) if rng.random() < 0.3)
    g = graph(spark, text, 24).persist()
    m, a = g.totals(), partition.singletons(g)
    for turn in range(3):
        taken = moves.together(moves.best_moves(moves.candidates(g, a, objective, m)).filter("tgt is not null"), g, objective, m, 0, turn).toPandas()
        after = partition.apply_moves(a, spark.createDataFrame([(int(v), int(c)) for v, c in zip(taken["v"], taken["tgt"], strict=True)] or [(-1, -1)], "v long, c long"))
        assert partition.quality(g, after, objective) >= partition.quality(g, a, objective) + (1e-9 if len(taken) else 0)
        a = after


def test_contraction(spark):
    g = graph(spark, "0-1:2 0-2:1 1-3:2 2-4:3 3-4:4", 5)
    small = contract.aggregate_graph(g, labels(spark, 2, 2, 5, 5, 5))
    assert rows(small.graph.edges, "src", "dst", "w") == [(0, 0, 2.0), (0, 1, 3.0), (1, 1, 7.0)]
    assert rows(contract.coarse_partition(small.coarse_of, labels(spark, 4, 4, 9, 9, 9)), "v", "c") == [(0, 0), (1, 1)]
    with pytest.raises(ValueError):
        contract.coarse_partition(small.coarse_of, labels(spark, 0, 0, 0, 1, 1))


RING = "0-1:1 1-2:2 2-3:3 3-4:4 4-5:5 0-5:6"
RING_LOOPS = "0-0:2 0-1:1.5 1-2:2.5 2-3:3.5 3-4:4.5 4-5:5.5 5-5:6.5 1-4:7.5"


def sized(g, *sizes):
    nodes = g.nodes.sparkSession.createDataFrame(list(enumerate(map(float, sizes))), "v long, node_size double")
    return Graph(nodes, g.edges)


def test_coarse_partitions(spark):
    refined = labels(spark, 2, 2, 5, 7, 7, 9)
    g = sized(graph(spark, RING, 6), 2, 3, 5, 7, 11, 13).persist()
    small = contract.aggregate_graph(g, refined)
    small.graph = small.graph.persist()
    for c in ((0, 0, 0, 1, 1, 1), (4, 4, 4, 9, 9, 9)):
        found = contract.coarse_partition(small.coarse_of, labels(spark, *c), refined, 4)
        assert rows(found, "v", "c") == [(0, 0), (1, 0), (2, 1), (3, 1)]
        assert rows(partition.communities(small.graph, found), "c", "size") == [(0, 10.0), (1, 31.0)]
    alone = contract.aggregate_graph(g, partition.singletons(g))
    whole = labels(spark, 0, 0, 0, 1, 1, 1)
    assert rows(contract.coarse_partition(alone.coarse_of, whole, partition.singletons(g), 6), "v", "c") == rows(whole, "v", "c")
    assert rows(contract.coarse_partition(contract.aggregate_graph(g, whole).coarse_of, whole, whole, 2), "v", "c") == [(0, 0), (1, 1)]


def test_faulty_coarse_partitions(spark):
    g, whole, refined = graph(spark, RING, 6), labels(spark, 0, 0, 0, 1, 1, 1), labels(spark, 2, 2, 5, 7, 7, 9)
    of = contract.aggregate_graph(g, refined).coarse_of
    other = lambda v, c: spark.createDataFrame([(x, c if x == v else k) for x, k in rows(of, "v", "coarse")], "v long, coarse long")
    bad = [
        (of, whole.filter("v < 5"), refined, 4),
        (of, labels(spark, 0, 0, 0, 1, 1, 1, 1), refined, 4),
        (of, whole, refined.filter("v < 5"), 4),
        (other(0, -1), whole, refined, 4),
        (other(0, 4), whole, refined, 4),
        (other(0, 1), whole, refined, 4),
        (other(5, 2), whole, None, 4),
        (of, labels(spark, -1, 0, 0, 1, 1, 1), refined, 4),
        (of, labels(spark, 0, 1, 1, 1, 1, 1), refined, 4),
    ]
    for case in bad:
        with pytest.raises(ValueError):
            contract.coarse_partition(*case)


@pytest.mark.parametrize("objective", [ConstantPotts(0.05), Modularity(1.1)])
def test_contraction_keeps_quality_and_sums(spark, objective):
    g = sized(graph(spark, RING_LOOPS, 6), 2, 3, 5, 7, 11, 13).persist()
    whole, refined = labels(spark, 0, 0, 0, 1, 1, 1), labels(spark, 2, 2, 5, 7, 7, 9)
    small = contract.aggregate_graph(g, refined)
    up = contract.coarse_partition(small.coarse_of, whole, refined)
    key = lambda df: sorted((r["c"], r["size"], r["strength"], r["internal_w"]) for r in df.collect())
    assert key(partition.communities(small.graph, up)) == key(partition.communities(g, whole))
    assert partition.quality(small.graph, up, objective) == pytest.approx(partition.quality(g, whole, objective), abs=1e-10)


def test_same_seed_same_clusters(spark):
    """However the rows lie, and however often the log tells of rounds."""
    g = graph(spark, RING_LOOPS + " 0-3:0.5 2-5:0.25", 6)
    one = cluster(g, Modularity(1.0), Options(seed=7, max_levels=2, debug_interval=1))
    two = cluster(Graph(g.nodes.repartition(3), g.edges.repartition(5)), Modularity(1.0), Options(seed=7, max_levels=2, debug_interval=100))
    assert rows(one.assignment, "v", "c") == rows(two.assignment, "v", "c") and (one.levels, one.moves) == (two.levels, two.moves)


def test_unused_ids_through_moves(spark):
    rng = random.Random(12)
    n = 12
    c = [0, 0, 1, 3, 4, 5, 6, 8, 9, 11, 11, 11]
    for _ in range(8):
        empty = partition.smallest_unused(labels(spark, *c)).first()[0]
        assert empty == min(set(range(n + 1)) - set(c))
        # some move to it, some to where others are
        step = {v: rng.choice([empty, *c]) for v in rng.sample(range(n), 3)}
        got = partition.apply_moves(labels(spark, *c), spark.createDataFrame(list(step.items()), "v long, c long"))
        c = [step.get(v, k) for v, k in enumerate(c)]
        assert rows(got, "v", "c") == list(enumerate(c))


def test_refinement(spark):
    g = graph(spark, "0-0:10 0-1:1 0-2:2 0-3:3 0-4:4 1-2:0.25 2-3:0.5", 5)
    s = refine.refinement_stats(g, labels(spark, 0, 0, 0, 0, 1), labels(spark, 0, 0, 1, 2, 3), ConstantPotts(0.2)).filter("parent = 0")
    assert rows(s, "c", "n_members", "mass", "external_w") == [(0, 2, 2.0, 5.25), (1, 1, 1.0, 2.75), (2, 1, 1.0, 3.5)]
    t = graph(spark, TRIANGLES, 6)
    parent = labels(spark, 0, 0, 0, 1, 1, 1)
    one, two = (rows(refine.refine(t, parent, Modularity(1.0), 0.01, 5).repartition(k), "v", "c") for k in (1, 7))
    assert one == two and all((v < 3) == (c < 3) for v, c in one)
    with pytest.raises(ValueError):
        refine.refine(t, parent, Modularity(1.0), 0.0)


def test_levels(spark):
    found = cluster(graph(spark, PAIRS, 4), ConstantPotts(1.0), Options(seed=11))
    c = dict(rows(found.assignment, "v", "c"))
    assert c[0] == c[1] and c[2] == c[3]
    edgeless = Graph(spark.range(3).selectExpr("id v", "1.0D node_size"), graph(spark, "0-1", 2).edges.filter("false"))
    assert cluster(edgeless, ConstantPotts(0.5)).levels == 1
    empty = Graph(edgeless.nodes.filter("false"), edgeless.edges)
    assert cluster(empty, ConstantPotts(0.5)).levels == 0


LOOPS5 = "0-0:2 0-1:3 1-2:1.5 2-2:4 2-3:2 3-4:3.5 4-4:1"
WEIGHTED5 = "0-1:2.5 1-2:0.75 2-3:3 3-4:1.25 0-4:4.5 1-4:0.5"


@pytest.mark.parametrize(("text", "a", "potts", "modularity"), [(TRIANGLES, (0, 0, 0, 1, 1, 1), 0.4, 1.0), (WEIGHTED5, (0, 0, 1, 1, 1), 0.35, 0.8)])
def test_delta_with_vertex_sizes(spark, text, a, potts, modularity):
    g = graph(spark, text, len(a))
    sizes = spark.createDataFrame(list(zip(range(6), (2.0, 1.0, 3.0, 1.0, 2.0, 1.0), strict=True)), "v long, node_size double")
    g = Graph(g.nodes.select("v").join(sizes, "v"), g.edges).persist()
    at = labels(spark, *a)
    for objective in (ConstantPotts(potts), Modularity(modularity)):
        found = moves.candidates(g, at, objective).collect()
        before = partition.quality(g, at, objective)
        # about four of each list; test_phases has every move by definition
        for r in found[:: max(1, len(found) // 4)]:
            to = 9 if r["tgt"] is None else r["tgt"]
            after = partition.quality(g, partition.apply_moves(at, spark.createDataFrame([(r["v"], to)], "v long, c long")), objective)
            assert after - before == pytest.approx(r["delta"], abs=1e-10)


def test_smallest_unused_id(spark):
    a = labels(spark, 0, 0, 1, 3, 4, 5, 6, 8, 9, 11, 11, 11)
    assert partition.smallest_unused(a).first()[0] == 2
    assert partition.smallest_unused(partition.apply_moves(a, spark.createDataFrame([(0, 2)], "v long, c long"))).first()[0] == 7


def test_refinement_of_sized_vertices(spark):
    nodes = spark.createDataFrame([(0, 10.0), (1, 1.0), (2, 1.0)], "v long, node_size double")
    joined = Graph(nodes, graph(spark, "0-1:3", 3).edges)
    assert rows(refine.refine(joined, labels(spark, 0, 0, 1), ConstantPotts(0.2), 1e-6), "v", "c") in ([(0, 0), (1, 0), (2, 2)], [(0, 1), (1, 1), (2, 2)])
    path = Graph(nodes, graph(spark, "0-1:1 1-2:0.5", 3).edges)
    assert rows(refine.well_connected_nodes(path, labels(spark, 0, 0, 1), ConstantPotts(0.2)), "v", "ok")[0] == (0, False)
    # nothing can merge: every vertex stays alone, whatever its parent
    assert rows(refine.refine(path, labels(spark, 0, 0, 0), ConstantPotts(2.0)), "v", "c") == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize(("text", "n", "way"), [("0-1:2 0-2:1 1-2:2.5 3-4:3 4-5:2 3-5:2.5 2-3:0.5", 6, "rounds"), (LOOPS5, 5, "queue")])
def test_clusters_are_optimal_on_the_last_level(spark, text, n, way):
    g = graph(spark, text, n).persist()
    found = cluster(g, ConstantPotts(0.4), Options(seed=2, way=way))
    assert not moves.best_moves(moves.candidates(found.last, found.last_assignment, ConstantPotts(0.4), g.totals())).count()
    assert partition.quality(g, found.assignment, ConstantPotts(0.4)) > partition.quality(g, partition.singletons(g), ConstantPotts(0.4))
    assert found.moves and not found.assignment.filter("c < 0").count()


def test_options_and_faulty_assignments(spark):
    for bad in ({"theta": 0.0}, {"max_levels": -1}, {"way": "other"}, {"debug_interval": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
    g = graph(spark, "0-1 1-2 2-3", 4)
    for a in (labels(spark, 0, 0, 1), spark.createDataFrame([(0, 0), (1, None), (2, 1), (3, 1)], "v long, c long"), labels(spark, 0, -1, 1, 1), labels(spark, 0, 0, 1, 1, 1)):
        with pytest.raises(ValueError):
            contract.aggregate_graph(g, a)
    for a in (labels(spark, 0, -1), spark.createDataFrame([(0, None)], "v long, c long")):
        with pytest.raises(ValueError):
            partition.compact(a)
    assert rows(contract.aggregate_graph(g, labels(spark, 2, 2, 5, 9)).coarse_of, "v", "coarse") == [(0, 0), (1, 0), (2, 1), (3, 2)]
    ring = graph(spark, "0-0:5 0-1:2 1-1:7 1-2:3 2-3:4 3-3:11", 4)
    assert rows(contract.aggregate_graph(ring, labels(spark, 0, 0, 1, 1)).graph.edges, "src", "dst", "w") == [(0, 0, 14.0), (0, 1, 3.0), (1, 1, 15.0)]


def test_levelled_classes_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 14)
        near = {v: [] for v in range(n)}
        for u in range(n):
            for v in range(u):
                if rng.random() < 0.3:
                    near[u].append(v)
                    near[v].append(u)
        order = sorted(near, key=lambda v: (-len(near[v]), v))
        got = coloring._levelled(order, near)
        assert all(got[u] != got[v] for u in near for v in near[u])
        # no vertex can go from a class to one smaller by two
        size = {c: list(got.values()).count(c) for c in set(coloring._sequential(order, near).values())}
        assert not any(size[c] + 1 < size[got[v]] and all(got[u] != c for u in near[v]) for v in near for c in size)
        assert set(got.values()) <= set(size)


def test_ranks(spark):
    from blockgraph.runtime import ranked

    got = ranked(spark.createDataFrame([(x, 1) for x in (5, None, 3, 3, 9, 7)], "x int, part int").repartition(3), "x", "place").orderBy("place").collect()
    assert [(r["x"], r["part"], r["place"]) for r in got] == [(None, 1, 0), (3, 1, 1), (3, 1, 2), (5, 1, 3), (7, 1, 4), (9, 1, 5)]
    assert ranked(spark.range(0), "id", "place").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from blockgraph import cli

    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n6 6 7\n2 1\n3 2\n3 1\n4 3\n5 4\n6 5\n6 4\n")
    got = cli.main(["cluster", f"{tmp_path}/m.mtx", "0.50", "--way", "queue", "--out", str(tmp_path), "--debug-interval", "3"])
    assert (got["vertices"], got["edges"], got["blocks"], got["colors"], got["block_graph_edges"]) == (6, 7, 2, 2, 1)
    assert {"move_seconds", "cluster_seconds", "color_seconds", "seconds", "levels", "moves", "quality"} < set(got) and "blocks: 2" in capsys.readouterr().out
    row = cli.main(["evaluate", f"{tmp_path}/m.mtx", f"{tmp_path}/m_potts_gamma0.50.blk", f"{tmp_path}/m_potts_gamma0.50.bcol"])
    assert (row["internal_edges"], row["external_edges"], row["blocks_per_color"], row["nodes_per_color"]) == (6, 1, [1, 1], [3, 3])
    for bad in (["cluster", "x", "-1"], ["cluster", "x", "inf"], ["cluster", "x", "1;2"], ["cluster", "x", "1", "--debug-interval", "0"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    with pytest.raises(SystemExit):
        (tmp_path / "short.blk").mkdir()
        (tmp_path / "short.blk" / "part-0.txt").write_text("2\n1 1\n")
        cli.main(["evaluate", f"{tmp_path}/m.mtx", f"{tmp_path}/short.blk", f"{tmp_path}/m_potts_gamma0.50.bcol"])


def test_color_and_permutation_files(spark, tmp_path):
    from blockgraph.sources import files

    colors = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "v long, color long")
    files.write_colors(colors, 2, f"{tmp_path}/x.bcol")
    n, got = files.read_colors(spark, f"{tmp_path}/x.bcol", 4)
    assert n == 2 and rows(got.fillna(-1), "v", "color") == [(0, 1), (1, 0), (2, 1), (3, -1)]
    with pytest.raises(ValueError):
        files.write_colors(colors, 1, f"{tmp_path}/y.bcol")
    files.write_permutation(spark.createDataFrame([(1, 0), (0, 2), (2, 1)], "v long, to long"), f"{tmp_path}/p")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/p").collect()] == ["1 3", "2 1", "3 2"]


def test_coloring(spark):
    g = graph(spark, TRIANGLES, 6)
    got = dict(rows(coloring.greedy(g), "v", "color"))
    near = {v: {u for x in TRIANGLES.split() for a, b in [map(int, x.split("-"))] for u in ((b,) if a == v else (a,) if b == v else ())} for v in range(6)}
    want = {}
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        want[v] = next(c for c in itertools.count() if all(want.get(u) != c for u in near[v]))
    assert got == want
    for way in (coloring.greedy_balanced, coloring.greedy_levelled):
        assert not coloring.violations(g, way(g)).filter("n > 0").count()


def test_evaluation(spark):
    g = graph(spark, "0-1 0-2 1-3 2-3", 4)
    r = evaluate.report(g, labels(spark, 0, 0, 1, 1), 2).first()
    assert (r["internal_edges"], r["external_edges"], r["internal_ratio"], r["block_graph_edges"], r["avg_block_density"], r["modularity_unweighted"]) == (2, 2, 0.5, 1, 1.0, 0.0)
    signed = graph(spark, "0-1:-2 1-2:3 2-3:-4", 4)
    assert evaluate.modularity_weighted(signed, labels(spark, 0, 0, 1, 1)).first()[0] == pytest.approx(0.14197530864197522)
    assert evaluate.gini(spark.createDataFrame([(1,), (3,)], "x int"), "x").first()[0] == pytest.approx(0.25)


def test_matrix_and_block_files(spark, tmp_path):
    from blockgraph.sources import files

    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 4\n1 1 9\n2 1 5\n\n3 2\n1 3 7\n")
    assert rows(files.read_matrix(spark, str(tmp_path / "m.mtx")).edges, "src", "dst", "w") == [(0, 1, 5.0), (1, 2, 1.0)]
    (tmp_path / "bad.mtx").write_text("3 3 1\n4 1\n")
    with pytest.raises(Exception, match="bad entry"):
        files.read_matrix(spark, str(tmp_path / "bad.mtx")).edges.collect()
    files.write_blocks(labels(spark, 1, 0, 1), f"{tmp_path}/x.blk")
    assert files.read_blocks(spark, f"{tmp_path}/x.blk", 4)[0] == 2
    assert rows(files.read_blocks(spark, f"{tmp_path}/x.blk", 4)[1].fillna(-1), "v", "c") == [(0, 1), (1, 0), (2, 1), (3, -1)]
    assert files.output_name("a/b/x.y.mtx", "potts", "0.50", "blk") == "x.y_potts_gamma0.50.blk"
