"""Running totals of streams of edges, and files of several parts."""

import random
import shutil

import pytest

from blockgraph.graph import Graph
from blockgraph.operators import partition
from blockgraph.sources import files
from blockgraph.streaming import upkeep

SCHEMA = "src long, dst long, w double, sign int"


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, totals, at, edges):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(edges)
    upkeep.keep(totals(rows), f"{at}/totals", f"{at}/state", availableNow=True).awaitTermination()


def numbers(at):
    return sorted(int(p.name.partition("=")[2]) for p in (at / "totals").iterdir() if p.name.startswith("batch="))


def test_totals_of_a_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(12), rng.choice((1.0, 2.5, -0.5)), 1) for _ in range(60)]
    gone = rng.sample(rows, 20)
    batches = [rows[:30], rows[30:], [(a, b, w, -1) for a, b, w, _ in gone] + [(None, 1, 1.0, 1), (1, 2, None, 1), (1, 2, 3.0, None)]]
    edges, at = str(tmp_path / "edges"), tmp_path / "v"
    for b in batches:
        put(spark, b, edges)
    run(spark, upkeep.strengths, at, edges)
    assert numbers(at) == [0, 1, 2]
    left = list(rows)
    for r in gone:
        left.remove(r)
    g = Graph.from_edges(spark.createDataFrame([r[:3] for r in left], "src long, dst long, w double"), w="w", nodes=spark.range(12).withColumnRenamed("id", "v"))
    want = {r["v"]: (r["degree"], pytest.approx(r["strength"])) for r in g.degree().join(g.strengths(), "v").collect()}
    read = lambda: {r["v"]: (r["degree"], r["strength"]) for r in upkeep.current(spark, f"{at}/totals", "v").collect()}
    assert read() == want
    # the last batch again, as after a driver that was lost before it was marked as done: the same rows once
    before = spark.read.parquet(f"{at}/totals/batch=2").count()
    for name in ("2", ".2.crc"):
        (at / "state" / "commits" / name).unlink()
    run(spark, upkeep.strengths, at, edges)
    assert read() == want and spark.read.parquet(f"{at}/totals/batch=2").count() == before
    # a new batch goes on from the state
    put(spark, [(0, 0, 4.0, 1), (0, 40, 1.0, 1)], edges)
    run(spark, upkeep.strengths, at, edges)
    now = read()
    assert now[40] == (1, 1.0) and now[0] == (want[0][0] + 2, pytest.approx(want[0][1].expected + 9))
    # folding keeps every total, twice over or stopped before it deletes
    shutil.copytree(at / "totals" / "batch=1", tmp_path / "old")
    assert upkeep.fold(spark, f"{at}/totals", "v") == 2 and numbers(at) == [2, 3] and read() == now
    shutil.copytree(tmp_path / "old", at / "totals" / "batch=1")
    assert read() == now and upkeep.fold(spark, f"{at}/totals", "v") == 2 and read() == now
    assert upkeep.fold(spark, f"{at}/totals", "v") is None


def test_community_totals_of_a_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(12), rng.randrange(12), rng.choice((1.0, 2.5)), 1) for _ in range(50)]
    a = spark.createDataFrame([(v, v % 4 if v < 10 else None) for v in range(11)], "v long, c long")
    edges, at = str(tmp_path / "edges"), tmp_path / "c"
    for b in (rows[:25], rows[25:]):
        put(spark, b, edges)
    run(spark, lambda e: upkeep.communities(e, a), at, edges)
    g = Graph.from_edges(spark.createDataFrame([r[:3] for r in rows], "src long, dst long, w double"), w="w")
    want = sorted((r["c"], r["strength"], r["internal_w"]) for r in partition.communities(g, a).collect())
    assert sorted(map(tuple, upkeep.current(spark, f"{at}/totals", "c").select("c", "strength", "internal_w").collect())) == want


def test_an_empty_stream(spark, tmp_path):
    put(spark, [], str(tmp_path / "edges"))
    run(spark, upkeep.strengths, tmp_path / "v", str(tmp_path / "edges"))
    put(spark, [(1, 2, 1.0, 1)], str(tmp_path / "edges"))
    run(spark, upkeep.strengths, tmp_path / "v", str(tmp_path / "edges"))
    assert sorted(map(tuple, upkeep.current(spark, f"{tmp_path}/v/totals", "v").collect())) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_files_in_parts(spark, tmp_path):
    rng = random.Random(9)
    n, key = 500, "spark.sql.adaptive.coalescePartitions.enabled"
    to = rng.sample(range(n), n)
    perm = spark.createDataFrame(list(enumerate(to)), "v long, to long").repartition(5)
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(900)})
    g = Graph.from_edges(spark.createDataFrame([(a, b, float(a + 1)) for a, b in edges], "src long, dst long, w double"), w="w", nodes=spark.range(n).withColumnRenamed("id", "v"))
    a = spark.range(n).selectExpr("id v", "id % 7 c").repartition(6)
    spark.conf.set(key, "false")
    try:
        files.write_blocks(a, f"{tmp_path}/x.blk")
        files.write_permutation(perm, f"{tmp_path}/p")
        files.write_reordered(g, perm, f"{tmp_path}/m")
    finally:
        spark.conf.unset(key)

    def lines(name):
        parts = sorted((tmp_path / name).glob("part-*"))
        assert len(parts) > 1
        return [x for p in parts for x in p.read_text().splitlines()]

    assert lines("x.blk") == ["7"] + [f"{v + 1} {v % 7 + 1}" for v in range(n)]
    assert lines("p") == [f"{v + 1} {to[v] + 1}" for v in range(n)]
    want = sorted((*sorted((to[a] + 1, to[b] + 1)), float(a + 1)) for a, b in edges)
    assert lines("m") == ["%%MatrixMarket matrix coordinate real symmetric", f"{n} {n} {len(want)}"] + [f"{i} {j} {w}" for i, j, w in want]
    k, got = files.read_blocks(spark, f"{tmp_path}/x.blk", n)
    assert k == 7 and {r["v"]: r["c"] for r in got.collect()} == {v: v % 7 for v in range(n)}
    back = files.read_matrix(spark, f"{tmp_path}/m", "any")
    assert back.num_vertices() == n and sorted((r["src"] + 1, r["dst"] + 1, r["w"]) for r in back.edges.collect()) == want


def test_the_first_part_has_the_first_line_and_the_last_line_wins(spark, tmp_path):
    (tmp_path / "x").mkdir()
    # the later part is longer, so that Spark reads it first
    (tmp_path / "x" / "part-0").write_text("2\n1 1\n2 1\n")
    (tmp_path / "x" / "part-1").write_text("1 2\n" + "3 2\n" * 400)
    k, got = files.read_blocks(spark, str(tmp_path / "x"), 3)
    assert k == 2 and {r["v"]: r["c"] for r in got.collect()} == {0: 1, 1: 0, 2: 1}
