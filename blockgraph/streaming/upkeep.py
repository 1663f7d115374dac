"""Sums of a graph that changes by a stream of edges: Structured Streaming's state holds the running totals, and each
micro-batch writes the totals that it changed.

An edge row is (src, dst, w), with src and dst in any order; a column sign, if there is one, is 1 for an edge that comes
and -1 for one that goes. A row with a null end, weight or sign changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..runtime import children, remove


def _signed(edges: DataFrame) -> DataFrame:
    sign = F.col("sign").cast("long") if "sign" in edges.columns else F.lit(1).cast("long")
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"), sign.alias("sign"))
    return e.dropna()


def _ends(e: DataFrame, a: str, b: str, name: str, inner) -> DataFrame:
    """(name, n, strength, internal_w) of each end of the edges, of which a and b are the ends' values; a self-loop has
    one end of twice its weight. inner: whether the edge is inside of what a names."""
    w = F.col("w") * F.col("sign")
    row = lambda c, k, own: F.struct(F.col(c).alias(name), F.col("sign").alias("n"), (w * k).alias("strength"), F.when(own, w).otherwise(0.0).alias("internal_w"))
    ends = F.when(F.col("src") == F.col("dst"), F.array(row(a, 2.0, inner))).otherwise(F.array(row(a, 1.0, inner), row(b, 1.0, F.lit(False))))
    return e.select(F.explode(ends).alias("e")).select("e.*").filter(F.col(name).isNotNull())


def strengths(edges: DataFrame) -> DataFrame:
    """(v, degree, strength): running totals of the vertices that the edges touch; a self-loop counts once in the
    degree and twice in the strength."""
    ends = _ends(_signed(edges), "src", "dst", "v", F.lit(False))
    return ends.groupBy("v").agg(F.sum("n").alias("degree"), F.sum("strength").alias("strength"))


def communities(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(c, strength, internal_w): running totals of the communities that the edges touch, under an assignment (v, c)
    that stays. Ends without a community count nowhere; an edge is inside if both of its ends are."""
    side = lambda v, c: assignment.select(F.col("v").alias(v), F.col("c").alias(c))
    e = _signed(edges).join(side("src", "cu"), "src", "left").join(side("dst", "cv"), "dst", "left")
    ends = _ends(e, "cu", "cv", "c", F.coalesce(F.col("cu") == F.col("cv"), F.lit(False)))
    return ends.groupBy("c").agg(F.sum("strength").alias("strength"), F.sum("internal_w").alias("internal_w"))


def keep(totals: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream of running totals: each micro-batch writes the rows that it changed to path/batch=<its number>.

    A batch that runs again, as after a lost driver, overwrites its own folder with the same rows. trigger: as of
    `DataStreamWriter.trigger`.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(**trigger) if trigger else out).start()


def current(spark: SparkSession, path: str, key: str, upto: int | None = None) -> DataFrame:
    """The totals after the last batch, or after batch upto: the newest row of each key."""
    rows = spark.read.option("basePath", path).parquet(path)
    names = [c for c in rows.columns if c not in (key, "batch")]
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("now")).select(key, "now.*")


def fold(spark: SparkSession, path: str, key: str) -> int | None:
    """Bring all batches but the last into one, so that reading costs as much as the totals and not as the stream did.

    The last one is left alone, since the stream may run it again. The newest rows are added to the last but one and
    the older ones deleted: stopped between, it leaves rows twice, which `current` doesn't mind. Readers that began
    before may miss files. Returns the batch that holds the rows, None if there was nothing to do.
    """
    numbers = sorted(int(name.partition("=")[2]) for name in children(spark, path) if name.startswith("batch="))
    if len(numbers) < 3:
        return None
    to = numbers[-2]
    current(spark, path, key, to).write.mode("append").parquet(f"{path}/batch={to}")
    for number in numbers[:-2]:
        remove(spark, f"{path}/batch={number}")
    return to
