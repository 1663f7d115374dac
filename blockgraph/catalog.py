"""The library's queries by name, with their SQL, over graphs drawn from the order and event tables.

`cop`: parts bought in one order at least twice, a vertex for each part (some isolated). `evt`: event types that
follow each other for a user, with self-loops. Deterministic assignments: v % 7 (cop), v % 2 (evt); refined: v % 21.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.quality import ConstantPotts, ErdosRenyi, Modularity
from .graph import BROADCAST_ROWS, Graph
from .operators import coloring, contract, evaluate, moves, partition, refine
from .plans.cluster import Options, blocks_and_colors, cluster
from .runtime import cut, few_broadcasts, scratch
from .sources import files
from .streaming import upkeep

POTTS, MOD, ER = ConstantPotts(0.3), Modularity(1.1), ErdosRenyi(1.2)
#: Order lines of which a task takes the pairs, about: 2 million pairs.
LINES = 500_000
#: The price of a pair under ErdosRenyi(1).
PAIR_PRICE = "(SELECT m / (k * (k - 1) / 2) FROM m, (SELECT count(*)::DOUBLE AS k FROM n) z)"


def cop(spark: SparkSession, d: str, least: int = 2) -> Graph:
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    # read from the files' footers
    parts = max(1, li.count() // LINES)
    # partitions that follow the table keep a task's pairs few; so does a shuffle before the count, and pairs hardly repeat
    li = li.repartition(parts, "l_orderkey") if parts > 1 else li
    x, y = li.withColumnRenamed("l_partkey", "src"), li.withColumnRenamed("l_partkey", "dst")
    # sorted and merged: the table would be broadcast as long as it is small, through the driver
    pairs = x.join(y.hint("merge"), "l_orderkey").filter("src < dst").select("src", "dst")
    pairs = pairs.repartition(parts, "src", "dst") if parts > 1 else pairs
    e = pairs.groupBy("src", "dst").agg(F.count("*").alias("w")).filter(F.col("w") >= least)
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("v"))
    return Graph.from_edges(e, w="w", nodes=nodes, large=nodes.count() > BROADCAST_ROWS)


def evt(spark: SparkSession, d: str) -> Graph:
    e = spark.read.parquet(f"{d}/events.parquet")
    ids = e.select("event_type").distinct().withColumn("id", F.row_number().over(Window.orderBy("event_type")) - 1)
    step = e.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).filter("b is not null")
    step = step.join(ids.select(F.col("event_type").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("event_type").alias("b"), F.col("id").alias("dst")), "b")
    step = step.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("w"))
    return Graph.from_edges(step, w="w")


def mod(g: Graph, k: int) -> DataFrame:
    return g.nodes.select("v", (F.col("v") % k).alias("c"))


COP = """
e AS (SELECT x.l_partkey AS src, y.l_partkey AS dst, count(*)::DOUBLE AS w FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT p_partkey AS v FROM part),
p AS (SELECT v, v % 7 AS c FROM n),
f AS (SELECT v, v % 21 AS c FROM n)"""
EVT = """
o AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
i AS (SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events) q),
e AS (SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst, count(*)::DOUBLE AS w FROM o JOIN i x ON o.a = x.t JOIN i y ON o.b = y.t GROUP BY 1, 2),
n AS (SELECT DISTINCT v FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) q),
p AS (SELECT v, v % 2 AS c FROM n)"""
SHARED = """
he AS (SELECT src AS v, dst AS u, w FROM e UNION ALL SELECT dst, src, w FROM e),
nd AS (SELECT n.v, 1.0::DOUBLE AS node_size, coalesce(s.k, 0.0)::DOUBLE AS strength FROM n LEFT JOIN (SELECT v, sum(w) AS k FROM he GROUP BY v) s USING (v)),
m AS (SELECT sum(w) AS m, count(*) AS cnt FROM e),
dg AS (SELECT n.v, coalesce(q.d, 0)::BIGINT AS degree FROM n LEFT JOIN (SELECT v, count(*) AS d FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) z GROUP BY v) q USING (v)),
pe AS (SELECT e.*, a.c AS cu, b.c AS cv FROM e JOIN p a ON e.src = a.v JOIN p b ON e.dst = b.v),
com AS (SELECT c, count(*) AS n_members, sum(node_size) AS size, sum(strength) AS strength, coalesce((SELECT sum(w) FROM pe WHERE cu = cv AND cu = c), 0.0)::DOUBLE AS internal_w FROM p JOIN nd USING (v) GROUP BY c),
sym AS (SELECT v, u, w FROM he WHERE v <> u),
nbw AS (SELECT s.v, p.c, sum(s.w) AS w FROM sym s JOIN p ON s.u = p.v GROUP BY 1, 2),
bs AS (SELECT nd.v, p.c AS src, node_size, nd.strength, coalesce(ws.w, 0.0) AS w_src, com.size AS src_size, com.strength AS src_strength, com.n_members AS src_n FROM nd JOIN p USING (v) JOIN com ON com.c = p.c LEFT JOIN nbw ws ON ws.v = nd.v AND ws.c = p.c),
cand AS (SELECT bs.*, nbw.c AS tgt, nbw.w AS w_tgt, t.size AS tgt_size, t.strength AS tgt_strength FROM bs JOIN nbw ON nbw.v = bs.v AND nbw.c <> bs.src JOIN com t ON t.c = nbw.c UNION ALL SELECT *, NULL, 0.0, 0.0, 0.0 FROM bs WHERE src_n > 1),
dl AS (SELECT v, src, tgt, (w_tgt - w_src) - 0.3::DOUBLE * node_size * (tgt_size - (src_size - node_size)) AS dp, 2 * (w_tgt - w_src) - 1.1::DOUBLE * strength * (tgt_strength - (src_strength - strength)) / (SELECT m FROM m) AS dm FROM cand),
pb AS (SELECT b.c AS block, (SELECT count(*) FROM p WHERE p.c = b.c) AS nodes, (SELECT count(*) FROM pe WHERE cu = cv AND cu = b.c) AS internal_edges, (SELECT count(*) FROM (SELECT DISTINCT least(cu, cv), greatest(cu, cv) FROM pe WHERE cu <> cv AND (cu = b.c OR cv = b.c)) z) AS degree FROM (SELECT DISTINCT c FROM p) b),
ts AS (SELECT nd.v, p.c, strength, coalesce((SELECT sum(w) FROM sym JOIN p q ON q.v = sym.u WHERE sym.v = nd.v AND q.c = p.c), 0.0) AS w FROM nd JOIN p USING (v)),
ms AS (SELECT c, sum(1.0::DOUBLE) AS mp, sum(strength) AS mm FROM p JOIN nd USING (v) GROUP BY c)"""
REFINED = """
fe AS (SELECT e.*, a.c AS cu, b.c AS cv, x.c AS pu, y.c AS pv FROM e JOIN f a ON e.src = a.v JOIN f b ON e.dst = b.v JOIN p x ON e.src = x.v JOIN p y ON e.dst = y.v),
rs AS (SELECT p.c AS parent, f.c, count(*) AS n_members, sum(strength) AS mass, coalesce((SELECT sum(w) FROM fe WHERE pu = pv AND cu <> cv AND (cu = f.c OR cv = f.c)), 0.0) AS external_w FROM p JOIN f USING (v) JOIN nd USING (v) GROUP BY p.c, f.c)"""


def _sql(graph: str, final: str, more: str = "") -> str:
    return f"WITH RECURSIVE {graph},{SHARED}{',' + more if more else ''} {final}"


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _named(name: str, value) -> list:
    return [F.lit(name).alias("metric"), value.cast("double").alias("value")]


def _fine(g: Graph) -> DataFrame:
    """v % 21 within v % 7."""
    return mod(g, 21)


def _move_facts(g: Graph, found: DataFrame, objective, start: DataFrame) -> DataFrame:
    """Conserved sums through an assignment, and counts of what must not be."""
    found = cut(found)
    com = partition.communities(g, found)
    rows = [
        com.select(*_named("vertices", F.sum("n_members"))),
        com.select(*_named("size", F.sum("size"))),
        com.select(*_named("strength", F.round(F.sum("strength"), 6))),
        partition.faults(g, found).select(*_named("faults", F.sum("n"))),
        g.nodes.limit(1).select(*_named("lost_quality", F.lit(float(partition.quality(g, found, objective) < partition.quality(g, start, objective) - 1e-9)))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


FACTS = "SELECT 'vertices' AS metric, count(*)::DOUBLE AS value FROM n UNION ALL SELECT 'size', count(*)::DOUBLE FROM n UNION ALL SELECT 'strength', round(2 * (SELECT m FROM m), 6) UNION ALL SELECT 'faults', 0 UNION ALL SELECT 'lost_quality', 0"


def _pairs(g: Graph) -> DataFrame:
    """Each vertex with its heaviest neighbour, if that is mutual: a partition that any clustering should beat."""
    order = Window.partitionBy("v").orderBy(F.desc("w"), "u")
    best = g.sym().groupBy("v", "u").agg(F.sum("w").alias("w")).withColumn("r", F.row_number().over(order)).filter("r = 1").select("v", "u")
    mutual = best.join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["v", "u"]).select("v", F.least("v", "u").alias("to"))
    return g.nodes.select("v").join(mutual, "v", "left").select("v", F.coalesce("to", "v").alias("c"))


PAIRS = """
ph AS (SELECT v, u, row_number() OVER (PARTITION BY v ORDER BY sum(w) DESC, u) AS r FROM sym GROUP BY v, u),
pm AS (SELECT a.v, least(a.v, a.u) AS c FROM ph a JOIN ph b ON a.u = b.v AND b.u = a.v WHERE a.r = 1 AND b.r = 1),
pp AS (SELECT n.v, coalesce(pm.c, n.v) AS c FROM n LEFT JOIN pm USING (v)),
pc AS (SELECT pp.c, sum(node_size) AS size, sum(strength) AS strength, coalesce((SELECT sum(w) FROM e JOIN pp x ON x.v = e.src JOIN pp y ON y.v = e.dst WHERE x.c = y.c AND x.c = pp.c), 0.0) AS inner_w FROM pp JOIN nd USING (v) GROUP BY pp.c)"""


def _beats_pairs(g: Graph, found: DataFrame, objective) -> DataFrame:
    bound = partition.quality(g, _pairs(g), objective)
    beats = float(partition.quality(g, found, objective) > bound)
    return g.nodes.limit(1).select(*_named("bound", F.lit(round(bound, 6)))).union(g.nodes.limit(1).select(*_named("beats_bound", F.lit(beats))))


def _beaten(objective) -> str:
    if isinstance(objective, ErdosRenyi):
        return f" UNION ALL SELECT 'bound', round(sum(inner_w - {objective.gamma}::DOUBLE * {PAIR_PRICE} * size * (size - 1) / 2), 6) FROM pc UNION ALL SELECT 'beats_bound', 1"
    q = f"inner_w - {objective.gamma}::DOUBLE * size * (size - 1) / 2" if isinstance(objective, ConstantPotts) else f"2 * inner_w - {objective.gamma}::DOUBLE * strength * strength / (2 * (SELECT m FROM m))"
    return f" UNION ALL SELECT 'bound', round(sum({q}), 6) FROM pc UNION ALL SELECT 'beats_bound', 1"


def _local_move(s, d, way, objective):
    g = cop(s, d).persist().prepared()
    start = partition.singletons(g)
    found = way(g, start, objective, 3).assignment
    left = moves.best_moves(moves.candidates(g, found, objective), 1e-9)
    return _move_facts(g, found, objective, start).union(left.select(*_named("improving_moves", F.count("*")))).union(_beats_pairs(g, found, objective))


def _pieces(g: Graph, found: DataFrame) -> int:
    """Number of connected pieces that the communities consist of."""
    a = found.select(F.col("v").alias("u"), F.col("c").alias("cu"))
    inner = cut(g.sym().join(g.spread(found), "v").join(g.spread(a), "u").filter("c = cu").select("v", "u").distinct())
    label = cut(g.nodes.select("v", F.col("v").alias("low")))
    while True:
        low = inner.join(g.spread(label.withColumnRenamed("v", "u")), "u").groupBy("v").agg(F.min("low").alias("near"))
        new = cut(g.spread(label).join(low, "v", "left").select("v", F.least("low", "near").alias("low"), (F.col("near") < F.col("low")).alias("changed")))
        label = new.select("v", "low")
        if not new.filter("changed").take(1):
            return label.select("low").distinct().count()


def _advanced(s, d):
    """Community sums kept through three batches of moves: multiples of 3 to 3, of 5 to 11, of 2 to one less."""
    g = cop(s, d).persist().prepared()
    a = mod(g, 7)
    com = partition.communities(g, a)
    for divisor, to in ((3, F.lit(3)), (5, F.lit(11)), (2, F.col("c") - 1)):
        step = a.filter(F.col("v") % divisor == 0).select("v", to.cast("long").alias("c"))
        com = cut(partition.advance_communities(g, com, a, step))
        a = cut(partition.apply_moves(g.spread(a), step))
    return com


ADVANCED = COP.replace("p AS (SELECT v, v % 7 AS c FROM n)", "p AS (SELECT v, c - (v % 2 = 0)::BIGINT AS c FROM (SELECT v, CASE WHEN v % 5 = 0 THEN 11 WHEN v % 3 = 0 THEN 3 ELSE v % 7 END AS c FROM n) z)")


def _refined_advanced(s, d):
    """refinement_stats of v % 21 within v % 7, kept while every fifth vertex joins the next part of its parent."""
    g = cop(s, d).persist().prepared()
    parent, refined = mod(g, 7), _fine(g)
    step = refined.filter("v % 5 = 0").select("v", ((F.col("c") + 7) % 21).alias("c"))
    return refine.advance_refinement(g, refine.refinement_stats(g, parent, refined, MOD), parent, refined, step, MOD)


def _weights(batches):
    """Partial counts of edge weights, one row for each weight of a batch."""
    import pyarrow as pa

    for b in batches:
        n = pa.Table.from_batches([b]).group_by("w").aggregate([("src", "count")])
        yield from n.rename_columns(["n" if c == "src_count" else c for c in n.column_names]).select(["w", "n"]).to_batches()


def _refine(s, d, objective, **more):
    """Facts of a refinement: parts lie in one parent each, are connected, fewer than the vertices and better than these alone."""
    with few_broadcasts(s):
        return cut(_refine_facts(cop(s, d).persist().prepared(), objective, **more))


def _refine_facts(g: Graph, objective, **more) -> DataFrame:
    parent = mod(g, 7)
    found = cut(refine.refine(g, parent, objective, 0.01, 3, **more))
    both = found.join(g.spread(parent.withColumnRenamed("c", "p")), "v").groupBy("c").agg(F.count_distinct("p").alias("k")).filter("k > 1")
    n, parts = g.num_vertices(), found.select("c").distinct().count()
    gained = partition.quality(g, found, objective) > partition.quality(g, partition.singletons(g), objective) + 1e-9
    # vertices without an edge may join any part: their gain is 0 everywhere
    tied = cut(found.join(g.spread(g.strengths().filter("strength > 0").select("v")), "v", "left_semi"))
    split = _pieces(Graph(tied.select("v"), g.edges, g.kept, large=g.large), tied) - tied.select("c").distinct().count()
    facts = {"merged": float(parts < n), "split_parts": float(split), "gained": float(gained)}
    out = _move_facts(g, found, objective, partition.singletons(g)).union(both.select(*_named("across_parents", F.count("*"))))
    for name, value in facts.items():
        out = out.union(g.nodes.limit(1).select(*_named(name, F.lit(value))))
    return out


REFINED_FACTS = FACTS + " UNION ALL SELECT 'across_parents', 0 UNION ALL SELECT 'merged', 1 UNION ALL SELECT 'split_parts', 0 UNION ALL SELECT 'gained', 1"


def _cluster(s, d, objective, way="queue"):
    """Facts of a clustering: no vertex of its last level gains by a move, and it beats the mutual pairs."""
    g = cop(s, d).persist().prepared()
    found = cluster(g, objective, Options(seed=3, way=way))
    left = moves.best_moves(moves.candidates(found.last, found.last_assignment, objective, g.totals()), 1e-9)
    return _move_facts(g, found.assignment, objective, partition.singletons(g)).union(left.select(*_named("improving_moves", F.count("*")))).union(_beats_pairs(g, found.assignment, objective))


CLUSTER_FACTS = FACTS + " UNION ALL SELECT 'improving_moves', 0"


def _stream(s, d, totals, key: str) -> tuple[Graph, DataFrame]:
    """The graph, and totals after a stream of its edges in three batches, of which every fifth goes again."""
    g = cop(s, d).persist()
    gone = g.edges.filter("(src + dst) % 5 = 0").withColumn("sign", F.lit(-1))
    at = scratch(s, "stream-")
    g.edges.withColumn("sign", F.lit(1)).union(gone).repartition(3).write.parquet(f"{at}/edges")
    rows = s.readStream.schema("src long, dst long, w double, sign int").option("maxFilesPerTrigger", 1).parquet(f"{at}/edges")
    upkeep.keep(totals(rows, g), f"{at}/totals", f"{at}/state", availableNow=True).awaitTermination()
    upkeep.fold(s, f"{at}/totals", key)
    return g, upkeep.current(s, f"{at}/totals", key)


def _stream_strengths(s, d):
    g, now = _stream(s, d, lambda rows, g: upkeep.strengths(rows), "v")
    return g.nodes.select("v").join(now, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.round(F.coalesce("strength", F.lit(0.0)), 6).alias("strength"))


def _stream_communities(s, d):
    _, now = _stream(s, d, lambda rows, g: upkeep.communities(rows, mod(g, 7)), "c")
    return now.select("c", *_r("strength", "internal_w"))


#: The graph that is left, and all its communities (those of no edge at all don't appear in a stream).
LEFT = COP.replace("e AS (SELECT x.l_partkey", "e0 AS (SELECT x.l_partkey").replace(",\nn AS", ",\ne AS (SELECT * FROM e0 WHERE (src + dst) % 5 <> 0),\nn AS")


def _matrix(s, d):
    """Through a file: the edges written and read again."""
    g = cop(s, d).persist()
    ids = cut(partition.compact_ids(g.nodes, "v").select("v", F.col("compact").alias("to")))
    back = ids.select(F.col("to").alias("x"), F.col("v").alias("old"))
    path = scratch(s, "matrix-")
    files.write_reordered(g, ids, path)
    got = files.read_matrix(s, path, "any").edges
    got = got.join(back.select(F.col("x").alias("src"), F.col("old").alias("a")), "src").join(back.select(F.col("x").alias("dst"), F.col("old").alias("b")), "dst")
    return got.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def _block_file(s, d):
    g = cop(s, d).persist()
    ids = partition.compact_ids(g.nodes, "v").select("v", F.col("compact").alias("to"))
    a = cut(g.spread(mod(g, 7)).join(ids, "v").select(F.col("to").alias("v"), "c"))
    path = scratch(s, "blocks-")
    files.write_blocks(a, path)
    nb, got = files.read_blocks(s, path, g.num_vertices())
    return got.select("v", "c", F.lit(nb).cast("long").alias("n_blocks"))


def _color_file(s, d):
    """Colours v % 3 of blocks 0 to 20, read for 25 blocks."""
    path = scratch(s, "colors-")
    files.write_colors(_fine(cop(s, d)).select(F.col("c").alias("v"), (F.col("c") % 3).alias("color")).distinct(), 3, path)
    nc, got = files.read_colors(s, path, 25)
    return got.select("v", "color", F.lit(nc).cast("long").alias("n_colors"))


def _permutation(s, d):
    """The lines of a permutation file: each part's place from the last."""
    path = scratch(s, "order-")
    ids = partition.compact_ids(cop(s, d).nodes, "v")
    n = ids.count()
    files.write_permutation(ids.select(F.col("compact").alias("v"), (F.lit(n) - 1 - F.col("compact")).alias("to")), path)
    return s.read.text(path).select(F.col("value").alias("line"))


def _lower(s, d):
    """The strict lower triangle of a file with both triangles and a diagonal; half of the entries have no value."""
    path = scratch(s, "matrix-")
    e = evt(s, d).edges.select((F.col("src") + 1).alias("i"), (F.col("dst") + 1).alias("j"), F.col("w").cast("long").alias("w"))
    both = e.union(e.filter("i < j").select("j", "i", F.col("w") + 1000))
    n = e.agg(F.max(F.greatest("i", "j"))).first()[0]
    lines = both.select("i", "j", F.concat_ws(" ", "i", "j", F.when(F.col("i") % 2 == 1, F.col("w"))).alias("line"))
    files.write_lines(lines, ["i", "j"], path, f"%%MatrixMarket matrix coordinate real general\n% note\n{n} {n} {both.count()}")
    return files.read_matrix(s, path).edges


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clustering, block graph, colouring and report of the co-purchase graph."""
    g = cop(spark, d).persist()
    found = blocks_and_colors(g, Modularity(1.0), Options(seed=1))
    ids = found.clustering.assignment
    return evaluate.report(g, ids, found.n_blocks, found.colors, found.n_colors)


def _colors_sql(degrees: str, near: str) -> str:
    """cl: greedy colours, in the order of degrees (v, degree), of the graph with the edges near (v, u), both ways."""
    return f"""
rk AS (SELECT v, row_number() OVER (ORDER BY degree DESC, v) AS i FROM {degrees}),
pr AS (SELECT a.i, list(DISTINCT b.i) AS l FROM {near} s JOIN rk a ON a.v = s.v JOIN rk b ON b.v = s.u WHERE b.i < a.i GROUP BY a.i),
nb AS (SELECT rk.i, rk.v, coalesce(pr.l, []) AS l FROM rk LEFT JOIN pr USING (i)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS cols UNION ALL
  SELECT nb.i, list_append(cols, coalesce(list_min(list_filter(range(0, len(l) + 1), lambda k: NOT list_contains(list_transform(l, lambda q: cols[q]), k))), 0)) FROM r JOIN nb ON nb.i = r.i + 1),
cl AS (SELECT rk.v, (SELECT cols FROM r ORDER BY i DESC LIMIT 1)[rk.i] AS color FROM rk)"""


COLORS_SQL = _colors_sql("dg", "sym")
#: The smallest class that no earlier neighbour has (lowest colour of equals), or a new one, vertex by vertex.
BALANCED_SQL = COLORS_SQL[: COLORS_SQL.index("r AS (SELECT 0")] + """
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS cols, []::BIGINT[] AS sizes UNION ALL
  SELECT i, list_append(cols, c), CASE WHEN c = len(sizes) THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda x, j: CASE WHEN j = c + 1 THEN x + 1 ELSE x END) END
  FROM (SELECT nb.i, cols, sizes, coalesce(list_min(list_transform(list_filter(range(0, len(sizes)), lambda k: NOT list_contains(list_transform(l, lambda q: cols[q]), k)), lambda k: sizes[k + 1] * 1000000 + k)) % 1000000, len(sizes)) AS c FROM r JOIN nb ON nb.i = r.i + 1) z),
cl AS (SELECT rk.v, (SELECT cols FROM r ORDER BY i DESC LIMIT 1)[rk.i] AS color FROM rk)"""
#: Blocks v % 211 and the moves between their colour classes, one a step: the first legal one, largest source and smallest target first.
BLOCKS = 211
LEVELLED_SQL = f"""
be AS (SELECT DISTINCT x.v % {BLOCKS} AS v, x.u % {BLOCKS} AS u FROM sym x WHERE x.v % {BLOCKS} <> x.u % {BLOCKS}),
bd AS (SELECT i AS v, (SELECT count(*) FROM be WHERE be.v = i) AS degree FROM range({BLOCKS}) z(i)),""" + _colors_sql("bd", "be") + f""",
nl AS (SELECT list(l ORDER BY v) AS near FROM (SELECT bd.v, list(be.u + 1) FILTER (WHERE be.u IS NOT NULL) AS l FROM bd LEFT JOIN be USING (v) GROUP BY bd.v) z),
lv AS (SELECT 0 AS step, (SELECT list(color ORDER BY v) FROM cl) AS cols UNION ALL
  SELECT step + 1, list_transform(cols, lambda x, j: CASE WHEN j = best % 4096 THEN best // 4096 % 64 ELSE x END)
  FROM (SELECT step, cols, list_min(list_transform(pairs, lambda p: ((({BLOCKS} - p.sa) * 64 + p.a) * 1024 + p.sb) * 262144 + p.b * 4096
          + list_min(list_filter(range(1, {BLOCKS} + 1), lambda v: cols[v] = p.a AND NOT coalesce(list_contains(list_transform(near[v], lambda q: cols[q]), p.b), false))))) AS best
        FROM (SELECT step, cols, near, list_filter(list_transform(range(len(sizes) * len(sizes)), lambda k: {{'a': k // len(sizes), 'b': k % len(sizes), 'sa': sizes[k // len(sizes) + 1], 'sb': sizes[k % len(sizes) + 1]}}), lambda p: p.sa > p.sb + 1) AS pairs
              FROM (SELECT step, cols, near, list_transform(range(list_max(cols) + 1), lambda c: len(list_filter(cols, lambda x: x = c))) AS sizes FROM lv, nl) x) y) z
  WHERE best IS NOT NULL AND step < {10 * BLOCKS})"""


def _levelled(s, d):
    g = cop(s, d).persist()
    return coloring.greedy_levelled(contract.block_graph(g, mod(g, BLOCKS), "binary", BLOCKS).persist())


BALANCE = "coalesce((SELECT 2 * sum(i * nodes) / (count(*) * sum(nodes)) - (count(*) + 1.0) / count(*) FROM (SELECT nodes, row_number() OVER (ORDER BY nodes) AS i FROM pb) z), 0)"

REPORT = ["internal_ratio", "locality_score", "avg_nodes", "stddev", "gini", "avg_block_density", "mean_internal_avg_degree", "block_graph_density", "avg_block_graph_degree", "modularity_unweighted", "modularity_weighted"]
COUNTS = ["num_vertices", "num_edges", "num_blocks", "num_colors", "internal_edges", "external_edges", "max_nodes", "min_nodes", "block_graph_edges"]


def _report(s, d):
    g = cop(s, d).persist()
    return evaluate.report(g, mod(g, 7), 7).select(*COUNTS, *_r(*REPORT))


def _report_colors(s, d):
    """With colours of the blocks; the arrays by colour as text."""
    g = cop(s, d).persist()
    colors = s.range(7).select(F.col("id").alias("v"), (F.col("id") % 3).alias("color"))
    row = evaluate.report(g, mod(g, 7), 7, colors, 3)
    return row.select("num_colors", *_r("block_imbalance", "color_imbalance"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("blocks_per_color", "nodes_per_color")])


REPORT_SQL = f"""SELECT (SELECT count(*) FROM n) AS num_vertices, (SELECT cnt FROM m) AS num_edges, 7 AS num_blocks, 0 AS num_colors, i AS internal_edges, x AS external_edges, max_nodes, min_nodes, block_graph_edges,
  round(i / (i + x), 6) AS internal_ratio, round(i / (x + 1), 6) AS locality_score, avg_nodes, stddev, gini, avg_block_density, mean_internal_avg_degree, block_graph_density, avg_block_graph_degree, modularity_unweighted, modularity_weighted
FROM (SELECT count(*) FILTER (WHERE cu = cv) AS i, count(*) FILTER (WHERE cu <> cv) AS x FROM pe) a,
  (SELECT max(nodes) AS max_nodes, min(nodes) AS min_nodes, round(avg(nodes), 6) AS avg_nodes, round(stddev_pop(nodes), 6) AS stddev, round({BALANCE}, 6) AS gini,
     round(sum(CASE WHEN nodes > 1 THEN internal_edges / (nodes * (nodes - 1) / 2) END) / count(*), 6) AS avg_block_density, round(sum(2 * internal_edges / nodes) / count(*), 6) AS mean_internal_avg_degree,
     (sum(degree) / 2)::BIGINT AS block_graph_edges, round(sum(degree) / (count(*) * (count(*) - 1)), 6) AS block_graph_density, round(avg(degree), 6) AS avg_block_graph_degree FROM pb) b,
  (SELECT round(sum(l / cnt - (k / (2.0 * cnt)) * (k / (2.0 * cnt))), 6) AS modularity_unweighted FROM m, (SELECT c, sum(degree) AS k, (SELECT count(*) FROM pe WHERE cu = cv AND cu = c) AS l FROM p JOIN dg USING (v) GROUP BY c) z) c,
  (SELECT round(sum(l / m - (k / (2 * m)) * (k / (2 * m))), 6) AS modularity_weighted FROM m, (SELECT c, sum(strength) AS k, (SELECT coalesce(sum(w), 0) FROM pe WHERE cu = cv AND cu = c) AS l FROM p JOIN nd USING (v) GROUP BY c) z) f"""
REPORT_COLORS_SQL = """SELECT 3 AS num_colors, round((SELECT max(nodes) / avg(nodes) FROM pb), 6) AS block_imbalance, round(max(x) / avg(x), 6) AS color_imbalance,
  string_agg(b::VARCHAR, ',' ORDER BY k) AS blocks_per_color, string_agg(x::VARCHAR, ',' ORDER BY k) AS nodes_per_color
FROM (SELECT c % 3 AS k, count(DISTINCT c) AS b, count(*) AS x FROM p GROUP BY 1) z"""


#: name: (query, SQL)
TABLE = {
    "graph_stats": (lambda s, d: cop(s, d).strengths(), _sql(COP, "SELECT * FROM nd")),
    "selfloop_stats": (lambda s, d: evt(s, d).strengths(), _sql(EVT, "SELECT * FROM nd")),
    "degree": (lambda s, d: cop(s, d).degree(), _sql(COP, "SELECT * FROM dg")),
    "degree_selfloops": (lambda s, d: evt(s, d).degree(), _sql(EVT, "SELECT * FROM dg")),
    "edge_count": (lambda s, d: evt(s, d).edges.agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight")), _sql(EVT, "SELECT cnt AS n_edges, m AS weight FROM m")),
    "vertex_count": (lambda s, d: cop(s, d).nodes.agg(F.count("*").alias("n")), _sql(COP, "SELECT count(*) AS n FROM n")),
    "binary_weights": (lambda s, d: cop(s, d).binary().edges, _sql(COP, "SELECT src, dst, 1.0::DOUBLE AS w FROM e")),
    "edge_weight": (lambda s, d: evt(s, d).edge_weight(2, 1), _sql(EVT, "SELECT w FROM e WHERE src = 1 AND dst = 2")),
    "unknown_vertices": (lambda s, d: Graph(cop(s, d).nodes.filter("v % 50 > 0"), cop(s, d).edges).strangers(), _sql(COP, "SELECT * FROM e WHERE src % 50 = 0 OR dst % 50 = 0")),
    "self_loops": (lambda s, d: evt(s, d).loops(), _sql(EVT, "SELECT src AS v, w FROM e WHERE src = dst")),
    "community_stats": (lambda s, d: partition.communities(cop(s, d), mod(cop(s, d), 7)), _sql(COP, "SELECT c, n_members, size, strength, internal_w FROM com")),
    "community_stats_selfloops": (lambda s, d: partition.communities(evt(s, d), mod(evt(s, d), 2)), _sql(EVT, "SELECT c, n_members, size, strength, internal_w FROM com")),
    "community_stats_brand": (
        lambda s, d: partition.communities(cop(s, d), s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("v"), F.col("p_brand").alias("c"))),
        _sql(COP.replace("v % 7 AS c FROM n)", "p_brand AS c FROM n JOIN part ON p_partkey = v)"), "SELECT c, n_members, size, strength, internal_w FROM com"),
    ),
    "id_bound": (lambda s, d: partition.id_bound(mod(cop(s, d), 7)), _sql(COP, "SELECT max(c) + 1 AS n FROM p")),
    "active_communities": (lambda s, d: partition.active(mod(cop(s, d), 7)), _sql(COP, "SELECT count(DISTINCT c) AS n FROM p")),
    "smallest_unused": (lambda s, d: partition.smallest_unused(mod(cop(s, d), 7)), _sql(COP, "SELECT min(i) AS c FROM range(0, 100) r(i) WHERE i NOT IN (SELECT c FROM p)")),
    "singletons": (lambda s, d: partition.singletons(cop(s, d)), _sql(COP, "SELECT v, v AS c FROM n")),
    "neighbor_community_weights": (lambda s, d: partition.neighbour_weights(cop(s, d), mod(cop(s, d), 7)), _sql(COP, "SELECT * FROM nbw")),
    "weight_into_community": (lambda s, d: partition.weight_into(evt(s, d), mod(evt(s, d), 2), 2, 0, True), _sql(EVT, "SELECT (SELECT w FROM nbw WHERE v = 2 AND c = 0) + coalesce((SELECT w FROM e WHERE src = 2 AND dst = 2), 0) AS w")),
    "quality_cpm": (lambda s, d: partition.valued(evt(s, d), mod(evt(s, d), 2), POTTS).agg(POTTS.quality(1.0).alias("q")).select(*_r("q")), _sql(EVT, "SELECT round(sum(internal_w - 0.3 * size * (size - 1) / 2), 6) AS q FROM com")),
    "quality_modularity": (lambda s, d: (lambda g: partition.valued(g, mod(g, 7), MOD).agg(MOD.quality(g.total_weight()).alias("q")).select(*_r("q")))(cop(s, d)), _sql(COP, "SELECT round(sum(2 * internal_w - 1.1::DOUBLE * strength * strength / (2 * (SELECT m FROM m))), 6) AS q FROM com")),
    "delta_move_cpm": (lambda s, d: moves.candidates(cop(s, d), mod(cop(s, d), 7), POTTS).select("v", "src", "tgt", *_r("delta")), _sql(COP, "SELECT v, src, tgt, round(dp, 6) AS delta FROM dl")),
    "delta_move_modularity": (lambda s, d: moves.candidates(cop(s, d), mod(cop(s, d), 7), MOD).select("v", "src", "tgt", *_r("delta")), _sql(COP, "SELECT v, src, tgt, round(dm, 6) AS delta FROM dl")),
    "best_move": (lambda s, d: moves.best_moves(moves.candidates(cop(s, d), mod(cop(s, d), 7), POTTS)).select("v", "tgt"), _sql(COP, "SELECT v, tgt FROM (SELECT v, tgt, row_number() OVER (PARTITION BY v ORDER BY dp DESC, tgt NULLS LAST) AS r FROM dl WHERE dp > 1e-12) z WHERE r = 1")),
    "apply_moves": (lambda s, d: (lambda a: partition.apply_moves(a, a.filter("v % 3 = 0").select("v", F.lit(99).cast("long").alias("c"))))(mod(cop(s, d), 7)), _sql(COP, "SELECT v, CASE WHEN v % 3 = 0 THEN 99 ELSE c END AS c FROM p")),
    "subset_mass": (lambda s, d: refine.subset_mass(cop(s, d), mod(cop(s, d), 7), MOD), _sql(COP, "SELECT c, mm AS mass FROM ms")),
    "edge_weight_to_subset": (lambda s, d: refine.weight_to_subset(cop(s, d), mod(cop(s, d), 7)), _sql(COP, "SELECT v, w FROM ts")),
    "well_connected_nodes_cpm": (lambda s, d: refine.well_connected_nodes(cop(s, d), mod(cop(s, d), 7), ConstantPotts(0.01)), _sql(COP, "SELECT v, c, w >= 0.01::DOUBLE * (mp - 1) AS ok FROM ts JOIN ms USING (c)")),
    "well_connected_nodes_modularity": (lambda s, d: refine.well_connected_nodes(cop(s, d), mod(cop(s, d), 7), Modularity(0.5)), _sql(COP, "SELECT v, c, w >= 0.5::DOUBLE / (2 * (SELECT m FROM m)) * strength * (mm - strength) AS ok FROM ts JOIN ms USING (c)")),
    "refinement_community_stats": (lambda s, d: refine.refinement_stats(cop(s, d), mod(cop(s, d), 7), _fine(cop(s, d)), MOD), _sql(COP, "SELECT * FROM rs", REFINED)),
    "well_connected_communities": (
        lambda s, d: refine.well_connected_communities(cop(s, d), mod(cop(s, d), 7), _fine(cop(s, d)), MOD),
        _sql(COP, "SELECT rs.*, external_w >= 1.1::DOUBLE / (2 * (SELECT m FROM m)) * mass * (mm - mass) AS ok FROM rs JOIN ms ON ms.c = rs.parent", REFINED),
    ),
    "aggregate_graph_nodes": (lambda s, d: contract.aggregate_graph(cop(s, d), _fine(cop(s, d))).graph.strengths(), _sql(COP, "SELECT c AS v, count(*)::DOUBLE AS node_size, sum(strength) AS strength FROM f JOIN nd USING (v) GROUP BY c")),
    "aggregate_graph_edges": (lambda s, d: contract.aggregate_graph(evt(s, d), mod(evt(s, d), 2)).graph.edges, _sql(EVT, "SELECT least(cu, cv) AS src, greatest(cu, cv) AS dst, sum(w) AS w FROM pe GROUP BY 1, 2")),
    **{
        f"block_graph_{mode}": (lambda s, d, mode=mode: contract.block_graph(cop(s, d), mod(cop(s, d), 7), mode).edges, _sql(COP, f"SELECT least(cu, cv) AS src, greatest(cu, cv) AS dst, {agg}::DOUBLE AS w FROM pe WHERE cu <> cv GROUP BY 1, 2"))
        for mode, agg in (("binary", "1.0"), ("count", "count(*)"), ("abs_sum", "sum(abs(w))"))
    },
    "coarse_partition": (lambda s, d: (lambda g: contract.coarse_partition(contract.aggregate_graph(g, _fine(g)).coarse_of, mod(g, 7)))(cop(s, d)), _sql(COP, "SELECT DISTINCT f.c AS v, p.c FROM f JOIN p USING (v)")),
    "flatten_levels": (lambda s, d: (lambda g: contract.flatten(_fine(g).withColumnRenamed("c", "coarse"), s.range(21).select(F.col("id").alias("v"), (F.col("id") % 7).alias("coarse"))))(cop(s, d)), _sql(COP, "SELECT v, c AS coarse FROM p")),
    "compact_ids": (lambda s, d: partition.compact(cop(s, d).nodes.select("v", (F.col("v") % 7 * 10 + 3).alias("c"))), _sql(COP, "SELECT v, c FROM p")),
    "members": (lambda s, d: partition.members(mod(cop(s, d), 7)).select("c", F.array_join("members", ",").alias("members")), _sql(COP, "SELECT c, string_agg(v::VARCHAR, ',' ORDER BY v) AS members FROM p GROUP BY c")),
    "block_members": (lambda s, d: partition.blocks(mod(evt(s, d), 2)).select("block", F.array_join("members", ",").alias("members")), _sql(EVT, "SELECT c AS block, string_agg(v::VARCHAR, ',' ORDER BY v) AS members FROM p GROUP BY c")),
    "assignment_faults": (lambda s, d: partition.faults(cop(s, d), mod(cop(s, d), 7).filter("v % 5 > 0").select("v", F.when(F.col("v") % 11 > 0, F.col("c")).alias("c"))), _sql(COP, "SELECT 'missing' AS fault, count(*) AS n FROM n WHERE v % 5 = 0 UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'unassigned', count(*) FROM n WHERE v % 5 > 0 AND v % 11 = 0")),
    "greedy_coloring": (lambda s, d: coloring.greedy(cop(s, d).persist()), _sql(COP, "SELECT v, color FROM cl", COLORS_SQL)),
    "relabel_colors": (lambda s, d: coloring.relabel_by_size(coloring.greedy(cop(s, d).persist())), _sql(COP, "SELECT v, k AS color FROM cl JOIN (SELECT color, row_number() OVER (ORDER BY count(*) DESC, color) - 1 AS k FROM cl GROUP BY color) z USING (color)", COLORS_SQL)),
    "coloring_violations": (lambda s, d: coloring.violations(cop(s, d), mod(cop(s, d), 7).withColumnRenamed("c", "color"), 6), _sql(COP, "SELECT 'uncoloured' AS fault, 0 AS n UNION ALL SELECT 'out_of_range', count(*) FROM p WHERE c >= 6 UNION ALL SELECT 'clash', count(*) FROM pe WHERE cu = cv AND src <> dst")),
    "greedy_coloring_balanced": (lambda s, d: coloring.greedy_balanced(cop(s, d).persist()), _sql(COP, "SELECT v, color FROM cl", BALANCED_SQL)),
    "greedy_coloring_levelled": (_levelled, _sql(COP, f"SELECT unnest(range({BLOCKS})) AS v, unnest(cols) AS color FROM (SELECT cols FROM lv ORDER BY step DESC LIMIT 1) z", LEVELLED_SQL)),
    "per_block": (lambda s, d: evaluate.per_block(cop(s, d), mod(cop(s, d), 7), 7), _sql(COP, "SELECT * FROM pb")),
    "edge_locality": (lambda s, d: evaluate.locality(cop(s, d), mod(cop(s, d), 7)).select("internal_edges", "external_edges", *_r("internal_ratio", "locality_score")), _sql(COP, "SELECT i AS internal_edges, x AS external_edges, round(i / (i + x), 6) AS internal_ratio, round(i / (x + 1), 6) AS locality_score FROM (SELECT count(*) FILTER (WHERE cu = cv) AS i, count(*) FILTER (WHERE cu <> cv) AS x FROM pe) z")),
    "block_density": (lambda s, d: evaluate.density(evaluate.per_block(evt(s, d), mod(evt(s, d), 2), 2)).select(*_r("avg_block_density", "mean_internal_avg_degree")), _sql(EVT, "SELECT round(sum(CASE WHEN nodes > 1 THEN internal_edges / (nodes * (nodes - 1) / 2) END) / count(*), 6) AS avg_block_density, round(sum(2 * internal_edges / nodes) / count(*), 6) AS mean_internal_avg_degree FROM pb")),
    "balance": (lambda s, d: evaluate.balance(evaluate.per_block(cop(s, d), mod(cop(s, d), 7), 7)).select("max_nodes", "min_nodes", *_r("avg_nodes", "stddev", "gini")), _sql(COP, f"SELECT max(nodes) AS max_nodes, min(nodes) AS min_nodes, round(avg(nodes), 6) AS avg_nodes, round(stddev_pop(nodes), 6) AS stddev, round({BALANCE}, 6) AS gini FROM pb")),
    "block_graph_density": (lambda s, d: evaluate.block_graph_stats(evaluate.per_block(cop(s, d), mod(cop(s, d), 7), 7)).select("block_graph_edges", *_r("block_graph_density", "avg_block_graph_degree")), _sql(COP, "SELECT (sum(degree) / 2)::BIGINT AS block_graph_edges, round(sum(degree) / (count(*) * (count(*) - 1)), 6) AS block_graph_density, round(avg(degree), 6) AS avg_block_graph_degree FROM pb")),
    "modularity_eval_unweighted": (lambda s, d: evaluate.modularity_unweighted(evt(s, d), mod(evt(s, d), 2)).select(*_r("modularity")), _sql(EVT, "SELECT round(sum(l / cnt - (k / (2.0 * cnt)) * (k / (2.0 * cnt))), 6) AS modularity FROM m, (SELECT c, sum(degree) AS k, (SELECT count(*) FROM pe WHERE cu = cv AND cu = c) AS l FROM p JOIN dg USING (v) GROUP BY c) z")),
    "modularity_eval_weighted": (
        lambda s, d: evaluate.modularity_weighted(evt(s, d), mod(evt(s, d), 2)).select(*_r("modularity")),
        _sql(EVT, "SELECT round(sum(l / t - (k / (2 * t)) * (k / (2 * t))), 6) AS modularity FROM (SELECT sum(abs(w)) AS t FROM e WHERE src <> dst) y, (SELECT c, sum(k) AS k, coalesce((SELECT sum(abs(w)) FROM pe WHERE cu = cv AND src <> dst AND cu = c), 0) AS l FROM p JOIN (SELECT v, sum(abs(w)) AS k FROM (SELECT src AS v, w FROM e UNION ALL SELECT dst, w FROM e WHERE src <> dst) q GROUP BY v) x USING (v) GROUP BY c) z"),
    ),
    "color_stats": (lambda s, d: evaluate.per_color(mod(cop(s, d), 7), s.range(7).select(F.col("id").alias("v"), (F.col("id") % 3).alias("color")), 4).select("color", "blocks", "nodes", *_r("avg_nodes_per_block")), _sql(COP, "SELECT k AS color, count(DISTINCT p.c) AS blocks, count(p.v) AS nodes, round(coalesce(count(p.v) / nullif(count(DISTINCT p.c), 0), 0), 6) AS avg_nodes_per_block FROM range(4) r(k) LEFT JOIN p ON p.c % 3 = k GROUP BY k")),
    "load_imbalance": (lambda s, d: evaluate.imbalance(evaluate.per_block(cop(s, d), mod(cop(s, d), 7), 7), evaluate.per_color(mod(cop(s, d), 7), s.range(7).select(F.col("id").alias("v"), (F.col("id") % 3).alias("color")), 3)).select(*_r("block_imbalance", "color_imbalance")), _sql(COP, "SELECT round((SELECT max(nodes) / avg(nodes) FROM pb), 6) AS block_imbalance, round((SELECT max(x) / avg(x) FROM (SELECT count(*) AS x FROM p GROUP BY (c % 3)) z), 6) AS color_imbalance")),
    "evaluation_report": (_report, _sql(COP, REPORT_SQL)),
    "evaluation_report_colors": (_report_colors, _sql(COP, REPORT_COLORS_SQL)),
    "local_move_rounds": (lambda s, d: _local_move(s, d, moves.local_move, ConstantPotts(0.5)), _sql(COP, CLUSTER_FACTS + _beaten(ConstantPotts(0.5)), PAIRS)),
    "local_move_queue": (lambda s, d: _local_move(s, d, moves.local_move_queue, Modularity(1.0)), _sql(COP, CLUSTER_FACTS + _beaten(Modularity(1.0)), PAIRS)),
    "refine_cpm": (lambda s, d: _refine(s, d, ConstantPotts(0.002)), _sql(COP, REFINED_FACTS)),
    "refine_modularity": (lambda s, d: _refine(s, d, Modularity(1.0)), _sql(COP, REFINED_FACTS)),
    "cluster_cpm": (lambda s, d: _cluster(s, d, ConstantPotts(0.5), "rounds"), _sql(COP, CLUSTER_FACTS + _beaten(ConstantPotts(0.5)), PAIRS)),
    "local_move_er": (lambda s, d: _local_move(s, d, moves.local_move_queue, ER), _sql(COP, CLUSTER_FACTS + _beaten(ER), PAIRS)),
    "delta_move_er": (
        lambda s, d: moves.candidates(cop(s, d), mod(cop(s, d), 7), ER).select("v", "src", "tgt", *_r("delta")),
        _sql(COP, f"SELECT v, src, tgt, round((w_tgt - w_src) - 1.2::DOUBLE * {PAIR_PRICE} * node_size * (tgt_size - (src_size - node_size)), 6) AS delta FROM cand"),
    ),
    "community_stats_incremental": (_advanced, _sql(ADVANCED, "SELECT c, n_members, size, strength, internal_w FROM com")),
    "refinement_stats_incremental": (_refined_advanced, _sql(COP.replace("f AS (SELECT v, v % 21 AS c FROM n)", "f AS (SELECT v, CASE WHEN v % 5 = 0 THEN (v % 21 + 7) % 21 ELSE v % 21 END AS c FROM n)"), "SELECT * FROM rs", REFINED)),
    "refine_distributed_cpm": (lambda s, d: _refine(s, d, ConstantPotts(0.002), task_edges=0), _sql(COP, REFINED_FACTS)),
    "refine_distributed_modularity": (lambda s, d: _refine(s, d, Modularity(1.0), task_edges=0), _sql(COP, REFINED_FACTS)),
    "edge_scan": (lambda s, d: cop(s, d).scan_edges(_weights, "w double, n long").groupBy("w").agg(F.sum("n").alias("n")), _sql(COP, "SELECT w, count(*) AS n FROM e GROUP BY w")),
    "cluster_modularity_queue": (lambda s, d: _cluster(s, d, Modularity(1.0), "queue"), _sql(COP, CLUSTER_FACTS + _beaten(Modularity(1.0)), PAIRS)),
    "cluster_modularity": (lambda s, d: _cluster(s, d, Modularity(1.0)), _sql(COP, CLUSTER_FACTS + _beaten(Modularity(1.0)), PAIRS)),
    "stream_strengths": (_stream_strengths, _sql(LEFT, "SELECT v, degree, round(strength, 6) AS strength FROM nd JOIN dg USING (v)")),
    "stream_communities": (_stream_communities, _sql(LEFT, "SELECT c, round(strength, 6) AS strength, round(internal_w, 6) AS internal_w FROM com WHERE c IN (SELECT unnest([src % 7, dst % 7]) FROM e0)")),
    "matrix_roundtrip": (_matrix, _sql(COP, "SELECT src, dst, w FROM e")),
    "block_file_roundtrip": (_block_file, _sql(COP, "SELECT row_number() OVER (ORDER BY v) - 1 AS v, c, 7 AS n_blocks FROM p")),
    "color_file_roundtrip": (_color_file, _sql(COP, "SELECT i AS v, CASE WHEN i < 21 THEN i % 3 END AS color, 3 AS n_colors FROM range(25) z(i)")),
    "permutation_file": (_permutation, _sql(COP, "SELECT (row_number() OVER (ORDER BY v))::VARCHAR || ' ' || (row_number() OVER (ORDER BY v DESC))::VARCHAR AS line FROM n")),
    "matrix_lower_triangle": (_lower, _sql(EVT, "SELECT src, dst, CASE WHEN (dst + 1) % 2 = 1 THEN w + 1000 ELSE 1 END::DOUBLE AS w FROM e WHERE src < dst")),
    "index_predicates": (lambda s, d: evaluate.valid(cop(s, d).nodes.select("v", (F.col("v") % 9 - 1).alias("c")), 7), _sql(COP, "SELECT v, CASE WHEN v % 9 BETWEEN 1 AND 7 THEN v % 9 - 1 END AS c FROM n")),
}


def queries():
    return {name: q for name, (q, _) in TABLE.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in TABLE.items()}
