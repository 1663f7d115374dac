"""Queries of the catalog on tables that are made here."""

import re

import pytest

from blockgraph import catalog, graph
from blockgraph.functions.quality import ConstantPotts, Modularity
from blockgraph.operators import moves, refine
from blockgraph.plans import cluster as plan
from blockgraph.runtime import BROADCAST, few_broadcasts
from blockgraph.sources import files


def test_lower_triangle_of_a_file_that_many_tasks_write(spark, tmp_path):
    # user u alternates between two of four types: (0, 1), (0, 2), ..., each as often as u has events
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a < b]
    rows = [(u * 100 + k, u * 100 + k, u, pairs[u % 6][k % 2]) for u in range(600) for k in range(8)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(r) for r in catalog.queries()["matrix_lower_triangle"](spark, str(tmp_path)).collect())
    finally:
        for k in keys:
            spark.conf.unset(k)
    # 100 users of a pair, 7 steps each; entries in even rows of the file have no value
    assert got == sorted((i, j, 1700.0 if (j + 1) % 2 else 1.0) for i in range(4) for j in range(4) if i < j)


def test_co_purchases_are_dealt_out_by_the_table(spark, tmp_path, monkeypatch):
    lines = [(o, (o * 7 + k * k * 3) % 40) for o in range(300) for k in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for o in range(300):
        own = [p for q, p in lines[o * 4 : o * 4 + 4]]
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0.0) + 1.0
    want = sorted((*k, w) for k, w in want.items() if w >= 2)
    for rows, parts in ((100, 12), (50, 24), (10_000, None)):
        monkeypatch.setattr(catalog, "LINES", rows)
        edges = catalog.cop(spark, str(tmp_path)).edges
        assert sorted(tuple(r) for r in edges.collect()) == want
        assert parts is None or edges.rdd.getNumPartitions() == parts
        # the lines never go through the driver
        assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """300 orders of 4 lines over 40 parts of 3 brands."""
    at = str(tmp_path_factory.mktemp("orders"))
    lines = [(o, (o * 7 + k * k * 3) % 40) for o in range(300) for k in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.range(40).selectExpr("id as p_partkey", "concat('b', id % 3) as p_brand").write.parquet(f"{at}/part.parquet")
    return at


@pytest.mark.parametrize("name", ["best_move", "binary_weights", "block_file_roundtrip", "block_graph_abs_sum", "block_graph_binary", "block_graph_count", "block_graph_density", "coloring_violations", "community_stats", "community_stats_brand", "community_stats_incremental", "degree", "delta_move_cpm", "delta_move_er", "delta_move_modularity"])
def test_vertices_of_a_large_graph_are_not_broadcast(spark, orders, monkeypatch, name):
    query = catalog.queries()[name]
    want = sorted(map(str, query(spark, orders).collect()))
    for module in (catalog, graph, files):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 39)
    got = query(spark, orders)
    # as it is planned before a stage has run: by the files' sizes
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(str, got.collect())) == want
    # src is a community in moves, and there are seven
    ends = "v|u" if "move" in name else "v|u|src|dst"
    assert not re.findall(rf"BroadcastHashJoin \[(?:{ends})#.*", plan)


def test_tables_of_a_graph_know_its_size(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "src long, dst long")
    for most, large in ((10, False), (9, True)):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
        g = graph.Graph.from_edges(edges).persist()
        assert [g.large, g.prepared().large, g.binary().large] == [large] * 3


def test_clustering_broadcasts_small_tables_only(spark, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key, None)
    try:
        for value, within in ((None, str(BROADCAST)), ("20m", str(BROADCAST)), ("100", "100"), ("-1", "-1")):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
            with few_broadcasts(spark):
                assert spark.conf.get(key) == within
            assert spark.conf.get(key, None) == value
        spark.conf.unset(key)

        def move(g, *args, **more):
            seen.append(spark.conf.get(key))
            return inner(g, *args, **more)

        seen, inner = [], moves.local_move_queue
        monkeypatch.setattr(plan.moves, "local_move_queue", move)
        edges = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double")
        plan.cluster(catalog.Graph.from_edges(edges, w="w"), Modularity(1.0), plan.Options(max_levels=1))
        assert seen == [str(BROADCAST)] and spark.conf.get(key, None) is None
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def test_refinement_of_a_large_graph_broadcasts_no_vertices(spark, orders, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    query = catalog.queries()["refine_cpm"]
    want = sorted(map(str, query(spark, orders).collect()))
    plans, inner = [], catalog.cut

    def cut(df, *args, **more):
        # as it is planned before a stage has run: by the files' sizes
        plans.append((df._jdf.queryExecution().sparkPlan().toString(), spark.conf.get(key)))
        return inner(df, *args, **more)

    for module in (catalog, graph):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 39)
    for module in (catalog, refine):
        monkeypatch.setattr(module, "cut", cut)
    got = sorted(map(str, query(spark, orders).collect()))
    assert got == want and "Row(metric='merged', value=1.0)" in got
    assert len(plans) > 5 and {limit for _, limit in plans} == {str(BROADCAST)}
    assert not [plan for plan, _ in plans if re.findall(r"BroadcastHashJoin \[(?:v|u|src|dst)#.*", plan)]
    # the seven parents' rows stay where they are
    assert any(re.findall(r"BroadcastHashJoin \[(?:c|cu)#.*", plan) for plan, _ in plans)


def test_refinement_by_rounds_broadcasts_small_tables_only(spark, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was, limits, inner = spark.conf.get(key, None), [], refine.cut

    def cut(df, *args, **more):
        limits.append(spark.conf.get(key))
        return inner(df, *args, **more)

    monkeypatch.setattr(refine, "cut", cut)
    nodes = spark.createDataFrame([(v, 0, 1.0) for v in range(3)], "v long, p long, x0 double")
    both = spark.createDataFrame([(0, 1, 5.0), (1, 0, 5.0)], "v long, u long, w double")
    found, _ = refine.refine_rounds(nodes, both, ConstantPotts(0.2), 5.0, 0.01, 1)
    assert sorted(r["c"] for r in found.collect()) in ([0, 0, 2], [1, 1, 2])
    assert len(limits) > 5 and set(limits) == {str(BROADCAST)} and spark.conf.get(key, None) == was
