"""Matrix files and block files, read and written by Spark's text source, so from any store that Spark reaches.

Ids are 1-based in files and 0-based in DataFrames. A file may be a folder of parts that are its lines in the order of
the parts' names; so are those written here, sorted in ranges by a task each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import BROADCAST_ROWS, Graph
from ..operators import partition


def file_stem(path: str) -> str:
    """The file's name without folders and last extension."""
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def output_name(path: str, method: str, resolution: str, kind: str) -> str:
    """<stem>_<method>_gamma<resolution>.<kind>, with the resolution as it was written."""
    return f"{file_stem(path)}_{method}_gamma{resolution}.{kind}"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, parts): the white-space separated parts of each line that is neither empty nor a comment, at in the order of
    files by name, their blocks and the lines of these."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.text(path).select("value", at.alias("at"))
    value = F.trim(F.regexp_replace("value", r"\s+", " "))
    return raw.select("at", value.alias("value")).filter("value <> '' and not startswith(value, '%')").select("at", F.split("value", " ").alias("parts"))


def _headed(spark: SparkSession, path: str) -> tuple[list[str] | None, DataFrame]:
    """(parts of the first line, None without any; the other lines)."""
    lines = _lines(spark, path)
    head = lines.agg(F.min(F.struct("at", "parts")).alias("h")).select("h.at", "h.parts").first()
    if head["parts"] is None:
        return None, lines
    same = (F.col("at.file") == head["at"]["file"]) & (F.col("at.block") == head["at"]["block"]) & (F.col("at.row") == head["at"]["row"])
    return head["parts"], lines.filter(~same)


def read_matrix(spark: SparkSession, path: str, triangle: str = "lower") -> Graph:
    """The graph of a coordinate matrix file: entries below the diagonal, an absent value as 1.

    triangle='any' takes entries above the diagonal too (self-loops never). :raises ValueError: if the size line is
    absent or the matrix isn't square; a malformed or out-of-range entry fails when it is read.
    """
    head, body = _headed(spark, path)
    size = head or []
    if len(size) < 3 or not all(re.fullmatch(r"\d+", x) for x in size[:3]):
        raise ValueError(f"{path}: no size line")
    if size[0] != size[1]:
        raise ValueError(f"{path}: {size[0]} x {size[1]} is not square")
    n = int(size[0])
    i, j = F.try_element_at("parts", F.lit(1)).try_cast("long"), F.try_element_at("parts", F.lit(2)).try_cast("long")
    w = F.when(F.size("parts") > 2, F.try_element_at("parts", F.lit(3)).try_cast("double")).otherwise(1.0)
    ok = i.between(1, n) & j.between(1, n) & w.isNotNull()
    entry = body.select(F.when(F.coalesce(ok, F.lit(False)), F.struct(i.alias("i"), j.alias("j"), w.alias("w"))).otherwise(F.raise_error(F.concat(F.lit("bad entry: "), F.array_join("parts", " ")))).alias("e")).select("e.*")
    entry = entry.filter("i > j" if triangle == "lower" else "i <> j")
    return Graph.from_edges(entry.select((F.col("i") - 1).alias("src"), (F.col("j") - 1).alias("dst"), "w"), w="w", nodes=spark.range(n).withColumnRenamed("id", "v"))


def write_lines(rows: DataFrame, order: list[str], path: str, head: str | None = None) -> None:
    """Rows (*order, line) sorted, after a first line if there is one: parts whose names are in the lines' order."""
    if head is not None:
        first = rows.sparkSession.range(1).select(*[F.lit(-1).cast("long").alias(c) for c in order], F.lit(head).alias("line"))
        rows = first.union(rows.select(*order, "line"))
    rows.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_blocks(assignment: DataFrame, path: str) -> None:
    """Number of blocks, then `node block`, by node. :raises ValueError: for an unassigned node."""
    if assignment.filter("c is null or c < 0").take(1):
        raise ValueError("every node needs a block")
    n = partition.id_bound(assignment).first()[0]
    write_lines(assignment.select("v", F.concat_ws(" ", F.col("v") + 1, F.col("c") + 1).alias("line")), ["v"], path, str(n))


def write_colors(colors: DataFrame, n_colors: int, path: str) -> None:
    """Number of colours, then `block color`, by block. :raises ValueError: for a colour out of range."""
    if colors.filter((F.col("color") < 0) | (F.col("color") >= n_colors) | F.col("color").isNull()).take(1):
        raise ValueError(f"colours must be from 0 to {n_colors - 1}")
    write_lines(colors.select("v", F.concat_ws(" ", F.col("v") + 1, F.col("color") + 1).alias("line")), ["v"], path, str(n_colors))


def _read_pairs(spark: SparkSession, path: str, n: int, name: str) -> tuple[int, DataFrame]:
    head, body = _headed(spark, path)
    if head is None:
        raise ValueError(f"{path}: no first line")
    pair = body.select("at", (F.col("parts")[0].cast("long") - 1).alias("v"), (F.col("parts")[1].cast("long") - 1).alias("x"))
    last = pair.groupBy("v").agg(F.max_by("x", "at").alias(name))
    last = last.hint("merge") if n > BROADCAST_ROWS else last
    return int(head[0]), spark.range(n).withColumnRenamed("id", "v").join(last, "v", "left")


def read_blocks(spark: SparkSession, path: str, n: int) -> tuple[int, DataFrame]:
    """(number of blocks, (v, c)) for nodes 0 .. n - 1: other nodes are ignored, the last of repeated lines counts, absent ones are null."""
    return _read_pairs(spark, path, n, "c")


def read_colors(spark: SparkSession, path: str, n_blocks: int) -> tuple[int, DataFrame]:
    """(number of colours, (v, color)) for blocks 0 .. n_blocks - 1, like read_blocks."""
    return _read_pairs(spark, path, n_blocks, "color")


def write_permutation(perm: DataFrame, path: str) -> None:
    """`old new` lines of perm (v, to), by old id."""
    write_lines(perm.select("v", F.concat_ws(" ", F.col("v") + 1, F.col("to") + 1).alias("line")), ["v"], path)


def reordered(g: Graph, perm: DataFrame) -> DataFrame:
    """(i, j, w) with i <= j, 0-based: the edges with their ends renamed by perm (v, to)."""
    side = lambda v, to: perm.select(F.col("v").alias(v), F.col("to").alias(to))
    e = g.edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return e.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "w")


def write_reordered(g: Graph, perm: DataFrame, path: str) -> None:
    """The renamed edges as a symmetric coordinate matrix file of the upper triangle, sorted."""
    e = reordered(g, perm)
    n = g.num_vertices()
    head = f"%%MatrixMarket matrix coordinate real symmetric\n{n} {n} {e.count()}"
    write_lines(e.select("i", "j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("w")).alias("line")), ["i", "j"], path, head)
