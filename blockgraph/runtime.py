"""Tables in the shared folder: how iterative operators cut lineage, and how they clean up behind them."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a row group: tables are read back soon, and their writers shouldn't buffer much.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Without one a folder of our own serves in local mode only. :raises RuntimeError: on a cluster without one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="blockgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _on(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _on(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    fs, at = _on(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds."""
    fs, at = _on(spark, path)
    fs.delete(at, True)


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new folder's path in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}{uuid.uuid4().hex}"
    fs, at = _on(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, and a lost executor costs no recomputation.

    The table goes with the application, or by `drop`; one at a path of the caller's stays. by: the last column, by
    whose values the table is laid out in folders, so that a filter on it reads those only.
    """
    spark = df.sparkSession
    mine = path is None
    path = f"{scratch(spark)}/t" if mine else path
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if mine:
        out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `cut` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            fs, at = _on(df.sparkSession, path)
            fs.delete(at.getParent(), True)


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with its rows' places 0, 1, ... in the order of column by, null first, as column name.

    Sorted in ranges, each by a task of its own; only the number of rows of each range goes through the driver. Equal
    values stand in any order. A column of that name is replaced.
    """
    df = df.drop(name)
    part, before = (next(c + "_" * k for k in range(99) if c + "_" * k not in [*df.columns, name]) for c in ("part", "before"))
    spread = cut(df.repartitionByRange(F.col(by).asc_nulls_first()).withColumn(part, F.spark_partition_id()))
    starts, total = [], 0
    for r in sorted(spread.groupBy(part).count().collect()):
        starts.append((r[0], total))
        total += r[1]
    starts = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(F.col(by).asc_nulls_first()))
    # one row a range
    return spread.join(F.broadcast(starts), part).withColumn(name, F.col(before) + place - 1).drop(part, before)


#: Rows that one window may hold.
WINDOW_ROWS = 1_000_000


def running(df: DataFrame, key: str, order: str, sums: dict[str, str], rows: int | None = None) -> DataFrame:
    """df with running sums added, by key in descending order of column order: of the rows before each one.

    sums: name of a sum and of its column. With at most WINDOW_ROWS rows (rows says how many there are, about) a window
    for each key does it; beyond that the rows are sorted in ranges, so that no key is one task's work.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if (df.count() if rows is None else rows) <= WINDOW_ROWS:
        w = before(Window.partitionBy(key).orderBy(F.desc(order)))
        return df.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0.0)) for name, c in sums.items()})
    part = next("part" + "_" * k for k in range(99) if "part" + "_" * k not in df.columns)
    spread = cut(df.repartitionByRange(F.col(key), F.desc(order)).withColumn(part, F.spark_partition_id()))
    # a row for each key and range that holds some of it
    earlier = before(Window.partitionBy(key).orderBy(part))
    each = spread.groupBy(key, part).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    each = each.select(key, part, *[F.coalesce(F.sum(name).over(earlier), F.lit(0.0)).alias(f"__{name}") for name in sums])
    w = before(Window.partitionBy(part, key).orderBy(F.desc(order)))
    out = spread.join(each, [key, part])
    return out.select(*df.columns, *[(F.col(f"__{name}") + F.coalesce(F.sum(c).over(w), F.lit(0.0))).alias(name) for name, c in sums.items()])


#: Bytes of a table that is broadcast, at most, while an operator makes rounds.
BROADCAST = 256 << 10


def _bytes(text: str) -> int:
    """What a size setting such as 10485760b, 10m or -1 says."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def few_broadcasts(spark: SparkSession):
    """Tables of over BROADCAST bytes are shuffled within, and smaller settings hold.

    A broadcast table goes through the driver; rounds join tables of a row for each vertex again and again, each of
    them small enough by Spark's own setting, but not all together.
    """
    one, other = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    # what was set, None where a setting is left to its default; the adaptive one is the other's then
    held = {k: spark.conf.get(k, None) for k in (one, other)}
    try:
        for k, v in held.items():
            if (k == one or v is not None) and _bytes(spark.conf.get(k)) > BROADCAST:
                spark.conf.set(k, str(BROADCAST))
        yield
    finally:
        for k, v in held.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_blockgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / "blockgraph_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._blockgraph_shipped = True
