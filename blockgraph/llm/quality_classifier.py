"""Supervised subword embeddings as a quality classifier.

A text is the average of learned vectors of its hashed words, word pairs and character 3- and 4-grams; a softmax
over two classes follows, and numpy stochastic gradient descent trains vectors and output together. For scoring,
the trained model is folded into one number a hash bucket, so that a text's score is a sum of table lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, crc, lean, release, ship, table, unused

#: Hash buckets, vector size, passes, learning rate; and how many labelled rows training may see at most.
BUCKETS, DIM, EPOCHS, RATE, TRAIN_ROWS = 1 << 16, 12, 6, 0.25, 3000
SEED = 5
#: Bytes of the texts that training may see, in all and each; the sample ends before the row that exceeds the first, and
#: longer texts aren't in it.
TRAIN_BYTES, TEXT_BYTES = 48 << 20, 1 << 20


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h = h * np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def features(texts: list[str]):
    """Yields (bucket, text index) arrays, each sorted by text: the feature occurrences of some texts, by kind.

    Character n-grams see white space as one mark and hold it at their ends only. A word pair of equal words has a
    bucket of its own besides, so that stuttering texts look alike.
    """
    joined = "".join("\n" + t for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    c = np.where(gap, np.uint32(32), points)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    doc = np.append(doc, np.int32(max(len(texts) - 1, 0)))
    mul = np.uint32(0x01000193)
    two = c[:-1] * mul + c[1:]
    three = two[:-1] * mul + c[2:]
    ok = ~gap[1:-1]
    yield _spread(three[ok] + np.uint32(3)), doc[1:-1][ok]
    four = three[:-1] * mul + c[3:]
    ok = ok[:-1] & ok[1:]
    yield _spread(four[ok] + np.uint32(0x51ED270B)), doc[1:-2][ok]
    # words: sums of spread code points by place, as cumulative sums modulo 2**32
    edge = np.flatnonzero(np.diff(gap.astype(np.int8)))
    start, stop = edge[::2] + 1, edge[1::2] + 1
    if not len(start):
        return
    inside = np.arange(len(c)) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), len(c))))
    power = np.multiply.accumulate(np.concatenate([[np.uint32(1)], np.full(63, np.uint32(0x9E3779B1))]).astype(np.uint32))
    sums = np.append(np.uint32(0), np.cumsum((c + np.uint32(1)) * power[inside & 63], dtype=np.uint32))
    word = sums[stop] - sums[start]
    of = doc[start]
    yield _spread(word ^ np.uint32(0x68E31DA4)), of
    same = of[1:] == of[:-1]
    yield _spread(word[:-1][same] * np.uint32(0x85EBCA6B) + word[1:][same]), of[1:][same]
    again = same & (word[1:] == word[:-1])
    yield np.zeros(int(again.sum()), np.uint32), of[1:][again]


def counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets, ascending, and how often each occurs."""
    ids, docs = zip(*features(texts), strict=True)
    key, n = np.unique(np.concatenate(docs).astype(np.int64) * BUCKETS + np.concatenate(ids), return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    # 6 bytes a feature: training holds those of all its texts
    ids, n = (key % BUCKETS).astype(np.uint16), n.astype(np.int32)
    return [(ids[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Model:
    #: Logit of label 1 over label 0: the mean of weight over a text's features, plus bias.
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; a text without features gets the bias's alone."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for ids, docs in features(texts) if texts else ():
            total += np.bincount(docs, self.weight[ids], len(texts))
            n += np.bincount(docs, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -50, 50)))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (text, label) rows, one row at a time, in a seeded order.

    Without rows, or with one label only, the model gives that label's smoothed share for every text.
    """
    labels = np.array([y for _, y in rows], np.int64)
    ones = int(labels.sum())
    if not ones or ones == len(rows):
        share = (ones + 1) / (len(rows) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    try:
        return _trained(rows, labels, epochs, rate, dim, seed)
    finally:
        # the driver's own process: what training took would stay with it to its end
        release()


def _trained(rows: list[tuple[str, int]], labels: np.ndarray, epochs: int, rate: float, dim: int, seed: int) -> Model:
    data = [x for a in range(0, len(rows), 64) for x in counts([t for t, _ in rows[a : a + 64]])]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, n = data[k]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            share = (n / max(n.sum(), 1)).astype(np.float32)
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out.T @ p
            out -= lr * np.outer(p, hidden)
            bias -= lr * p
            # features of a text share its gradient; the rate grows with the text so that averaging doesn't starve them
            vectors[ids] -= lr * 20 * np.outer(np.sqrt(share), back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, total: int = TRAIN_BYTES, each: int = TEXT_BYTES) -> list[tuple[str, int]]:
    """The bounded training sample: the first rows labelled documents, in the order of their ids' hashes.

    Rows whose crc32 of the id is 1 modulo 3 are held out. Rows without an id or label don't count; of an id with
    several labels the largest counts, of several texts the smallest. Texts of more than each bytes are left out, and
    the sample ends where its texts exceed total bytes; both are judged before anything is collected.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.filter(crc(F.col("id")) % 3 != 1).groupBy("id").agg(F.max("y").alias("y"))
    order = F.struct(F.md5(F.concat(F.lit("train:"), F.col("id").cast("string")).cast("binary")), "id")
    known = known.orderBy(order).limit(rows)
    few = F.broadcast(known)  # at most `rows` ids
    got = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.octet_length("t") <= each)
    got = got.join(few, "id").groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    # at most `rows` rows go through one task
    got = got.withColumn("upto", F.sum(F.octet_length("t").cast("long")).over(Window.orderBy(order)))
    return [(r["t"], r["y"]) for r in sorted(got.filter(F.col("upto") <= total).collect(), key=lambda r: r["id"])]


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all by default) with out_col added: the probability of label 1, for any text.

    Only the text is read for the score; null and empty texts get the model's prior. A column of the name of
    out_col is replaced.
    """
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if carry is None else carry) if c != out_col]
    kept = [F.col(f"`{c}`") for c in keep]
    base = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(unused(keep, "__text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    @lean
    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in chunks(pc.binary_length(texts).to_pylist()):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.scores(part.column(len(keep)).to_pylist()))], [*keep, out_col])

    return base.mapInArrow(run, StructType([*docs.select(*kept).schema.fields, StructField(out_col, DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(sample(docs, table(spark, sf_dir, "labels")))
    out = score(docs, model, carry=["doc_id"])
    return out.select("doc_id", (crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
