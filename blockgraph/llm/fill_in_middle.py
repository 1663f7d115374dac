"""Fill-in-middle by overlapping chunks.

A text is a row of units (code points, words or lines); whether a unit begins between two bytes is a predicate of these
two adjacent bytes. The texts of a batch are dealt into chunks that overlap by one byte, the predicate counts the units
that begin in each chunk, all chunks at once, and prefix sums over the counts say which chunk owns the rank of a cut:
only these chunks are scanned again for the byte at which it lies. A text of any length is many chunks of one size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import SPACE, chunks, lean, ship, table, unused

#: Bytes of a chunk, and how many chunks the predicate sees at once.
SIZE, AT_ONCE = 1024, 1024
#: Marks before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
#: Of each 100 texts so many are cut, and of those so many have the suffix first.
RATE, SPM = 90, 20

#: unit: whether one begins at the second of two adjacent bytes; one always begins with the text.
UNITS = {
    "codepoint": lambda a, b: (b & 0xC0) != 0x80,
    "word": lambda a, b: SPACE[a] & ~SPACE[b],
    "line": lambda a, b: a == 10,
}


class Chunked:
    """The units of some texts, counted by chunk; each chunk also sees the byte before its own."""

    def __init__(self, texts: list[bytes], unit: str = "codepoint"):
        self.begins, sizes = UNITS[unit], np.array([len(t) for t in texts], np.int64)
        # the byte before the first chunk
        self.buf = np.frombuffer(b"\0" + b"".join(texts) + bytes(SIZE), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        each = -(-sizes // SIZE)
        self.last = np.cumsum(each)
        #: Where the chunks begin, and where their texts begin and end.
        self.doc = np.repeat(np.arange(len(texts)), each)
        self.at = self.starts[self.doc] + SIZE * (np.arange(len(self.doc)) - (self.last - each)[self.doc])
        counts = [self._marks(np.arange(a, min(a + AT_ONCE, len(self.at)))).sum(1) for a in range(0, len(self.at), AT_ONCE)]
        #: Units that begin before each chunk, of all texts.
        self.before = np.concatenate([[0], *counts]).cumsum()
        self.base = self.before[self.last - each]
        self.n = self.before[self.last] - self.base

    def _marks(self, k: np.ndarray) -> np.ndarray:
        """For chunks k, a row each: at which bytes units begin."""
        where = self.at[k][:, None] + np.arange(SIZE)
        own = self.buf[where + 1]
        first = where == self.starts[self.doc[k]][:, None]
        return (self.begins(self.buf[where], own) | first) & (where < self.ends[self.doc[k]][:, None])

    def cut(self, rank: np.ndarray) -> np.ndarray:
        """For each text the bytes before its unit of that rank; all of them for the rank past the last."""
        out = self.ends - self.starts
        inner = np.flatnonzero(rank < self.n)
        whole = self.base[inner] + rank[inner]
        owner = np.searchsorted(self.before, whole, "right") - 1
        for a in range(0, len(inner), AT_ONCE):
            k, docs = owner[a : a + AT_ONCE], inner[a : a + AT_ONCE]
            place = (np.cumsum(self._marks(k), axis=1, dtype=np.int32) > (whole[a : a + AT_ONCE] - self.before[k])[:, None]).argmax(1)
            out[docs] = self.at[k] + place - self.starts[docs]
        return out


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four integers of the id: the first 8-digit groups of a sha256."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "codepoint", rate: int = RATE, spm: int = SPM, seed: int = 1, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all by default) with n, form, prefix_n, middle_n and output added (columns of those names are replaced).

    n is the number of units, prefix_n and middle_n how many the prefix and the middle have (null for form plain), and
    output the text in its form. Where a text is cut, and whether it is, is drawn from its id: rows of one id, or of
    none, are cut alike. A null text is an empty one; empty texts and those that hold a mark stay plain.
    """
    ship(docs.sparkSession)
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    added = [("n", LongType()), ("form", StringType()), ("prefix_n", LongType()), ("middle_n", LongType()), ("output", BinaryType())]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in dict(added)]
    kept = [F.col(f"`{c}`") for c in keep]
    text = unused(keep, "__text")
    base = docs.select(*kept, *[h.alias(unused(keep, f"__h{i}")) for i, h in enumerate(_draws(id_col, seed))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(text))
    width = len(keep)

    @lean
    def run(batches):
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(width + 4)).to_pylist()):
                part = batch.slice(a, b - a)
                h = [part.column(width + i).to_numpy() for i in range(4)]
                texts = part.column(width + 4).to_pylist()
                units = Chunked(texts, unit)
                one, two = h[0] % (units.n + 1), h[1] % (units.n + 1)
                lo, hi = np.minimum(one, two), np.maximum(one, two)
                cut = (h[2] % 100 < rate) & (units.n > 0) & np.array([not any(m in t for m in MARKS) for t in texts], bool)
                first, second = units.cut(lo).tolist(), units.cut(hi).tolist()
                form = np.where(cut, np.where(h[3] % 100 < spm, "spm", "psm"), "plain")
                out = []
                for t, f, i, j in zip(texts, form.tolist(), first, second, strict=True):
                    p, s, m = t[:i], t[j:], t[i:j]
                    out.append(t if f == "plain" else b"".join((MARKS[0], p, MARKS[1], s, MARKS[2], m) if f == "psm" else (MARKS[1], s, MARKS[0], p, MARKS[2], m)))
                cols = [pa.array(units.n), pa.array(form.tolist(), pa.string()), pa.array(lo, mask=~cut), pa.array(hi - lo, mask=~cut), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *cols], [*keep, *dict(added)])

    out = base.mapInArrow(run, StructType([*docs.select(*kept).schema.fields, *[StructField(n, t) for n, t in added]]))
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of that form was made of; null for a null output."""
    p, s, m = (x.decode() for x in MARKS)
    psm, rest = form == "psm", F.substr(output, F.lit(4))
    one = F.when(psm, F.substring_index(rest, s, 1)).otherwise(F.substring_index(rest, p, 1))
    rest = F.substr(output, F.char_length(one) + 7)
    two = F.substring_index(rest, m, 1)
    three = F.substr(rest, F.char_length(two) + 4)
    return F.when(form == "plain", output).when(psm, F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", F.col("prefix_n").alias("prefix_chars"), F.col("middle_n").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {RATE} THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM h
), c AS (
  SELECT doc_id, t, n, form, least(a, b) AS i, greatest(a, b) AS j, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM c
"""
