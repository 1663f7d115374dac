"""Filter interaction audit: what each filter removes in every order of the filters.

A document is the mask of the filters that it fails, and a part of the corpus the counts of its masks, 2**k cells at
most. All orders of the filters are visited by single swaps of neighbours (each permutation once, Johnson and Trotter's
way): a swap changes what the two swapped steps remove and nothing else, so only these are counted anew from the cells.
The Shapley values, sums over all orders of what a filter removes, grow along the walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, Words, chunks, inner_id, lean, ship, table

#: The filters A to D of a text; E, the repeat of an earlier text, is the fifth.
FILTERS = "ABCDE"
#: Fewer words than this fail A; a smaller share of distinct words B; a larger one of capitals C; any of these marks D.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
#: Rows without an id are dealt to so many keys.
SALT = 64


def masks(texts: list[bytes]) -> np.ndarray:
    """For each text the filters A to D that it fails, a bit each."""
    words = Words(texts)
    n = np.diff(words.first)
    distinct = np.unique(words.doc.astype(np.int64) * max(1, len(words.distinct)) + words.id)
    distinct = np.bincount(distinct // max(1, len(words.distinct)), minlength=len(texts))
    buf = np.frombuffer(words.bytes, np.uint8)
    # each text with the line feed after it, which no count takes
    starts = np.append(0, words.ends[:-1])
    count = lambda flag: np.add.reduceat(flag, starts, dtype=np.int64)
    points = count((buf & 0xC0) != 0x80) - 1
    capitals = count((buf >= 65) & (buf <= 90))
    signs = count(np.isin(buf, np.frombuffer(SIGNS, np.uint8)))
    return (n < LEAST_WORDS) * 1 + (100 * distinct < DISTINCT * n) * 2 + (100 * capitals > CAPITALS * points) * 4 + (signs > 0) * 8


def swaps(k: int) -> Iterator[int]:
    """Places i of the swaps of i and i + 1 that lead through all permutations of k, one after the other."""
    order, way = list(range(k)), [-1] * k
    while True:
        place = {x: i for i, x in enumerate(order)}
        free = [x for x in order if 0 <= place[x] + way[x] < k and order[place[x] + way[x]] < x]
        if not free:
            return
        x = max(free)
        i, j = sorted((place[x], place[x] + way[x]))
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, k):
            way[y] = -way[y]
        yield i


def walk(cells: np.ndarray, names: str = FILTERS) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    cells has a row for each mask: documents, good ones and toxic ones.
    """
    k, at = len(names), np.arange(1 << len(names))
    fails = [(at >> f & 1).astype(bool) for f in range(k)]
    total, failing = int(cells[:, 0].sum()), [int(cells[x, 0].sum()) for x in fails]
    alone = [int(cells[1 << f, 0]) for f in range(k)]
    order, shapley, rows = list(range(k)), [0] * k, []
    lost = np.zeros((k, 3), np.int64)

    def recount(steps) -> None:
        for i in steps:
            alive = at & sum(1 << f for f in order[:i]) == 0
            lost[i] = cells[alive & fails[order[i]]].sum(0)

    def visit() -> None:
        left, name = total, "".join(names[f] for f in order)
        for i, f in enumerate(order):
            n, good, toxic = map(int, lost[i])
            left -= n
            shapley[f] += n
            rows.append((name, i + 1, left, n, failing[f] - n, alone[f], good, toxic, f))

    recount(range(k))
    visit()
    for i in swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        recount((i, i + 1))
        visit()
    return [(*r[:-1], shapley[r[-1]]) for r in rows]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, digest) of each document: the filters A to D that it fails, and 128 bits of blake2b of its text."""
    ship(docs.sparkSession)
    base = docs.select(inner_id(F.col(id_col)).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    @lean
    def run(batches):
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(2)).to_pylist()):
                part = batch.slice(a, b - a)
                texts = part.column(2).to_pylist()
                digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(masks(texts).astype(np.int32)), digests], ["id", "part", "mask", "digest"])

    return base.mapInArrow(run, "id long, part string, mask int, digest binary")


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): for each part and mask of A to E the documents, those labelled good and those toxic.

    E fails where a smaller id has the same text; a null id is the largest. Of an id with several labels the largest
    count. Copies are counted before they are shuffled by text, so that a text of any number of copies is a few rows.
    """
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("k"))
    # rows without an id have no label, and are no key of their own
    salt = F.when(F.col("id") == LAST, F.pmod(F.xxhash64("digest"), F.lit(SALT)) + 1).otherwise(0).cast("int")
    rows = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0)), ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("k").alias("n"), F.min(F.struct("id", "k")).alias("least"))
    # a few rows for each text: parts and labels of its copies
    first = texts.groupBy("digest").agg(F.min("least.id").alias("first"))
    texts = texts.join(first, "digest").withColumn("pass", F.when(F.col("least.id") == F.col("first"), F.col("least.k")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("pass").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("pass")).alias("n")))
    texts = texts.select("part", "good", "toxic", F.explode(both).alias("e")).select("part", "e.mask", "e.n", (F.col("good") * F.col("e.n")).alias("good"), (F.col("toxic") * F.col("e.n")).alias("toxic"))
    return texts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of cells.

    One row for each part, order of the filters and step, zeros included; a part is 2**len(names) rows at most. An
    empty table has no parts and gives no rows.
    """
    ship(counted.sparkSession)
    cols = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table_ = np.zeros((1 << len(names), 3), np.int64)
        np.add.at(table_, pdf["mask"].to_numpy(), pdf[["n", "good", "toxic"]].to_numpy(np.int64))
        out = pd.DataFrame(walk(table_, names), columns=cols)
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    return counted.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in cols[2:]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(cells(failures(docs), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), count(doc_id) OVER (PARTITION BY t) > 0) AS e, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x AS (SELECT substr('ABCDE', i + 1, 1) AS l, 1 << i AS bit FROM range(5) r(i)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a JOIN x b ON b.l <> a.l JOIN x c ON c.l NOT IN (a.l, b.l) JOIN x d ON d.l NOT IN (a.l, b.l, c.l) JOIN x e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), s AS (
  SELECT filter_order, step, x.l, x.bit, coalesce((SELECT sum(y.bit) FROM x y WHERE position(y.l IN filter_order) < step), 0)::BIGINT AS earlier
  FROM o, range(1, 6) r(step) JOIN x ON true WHERE x.l = substr(filter_order, step, 1)
), g AS (
  SELECT part, filter_order, step, l, sum(n) FILTER (WHERE mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0) AS removed,
         sum(n) FILTER (WHERE mask & earlier > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
         sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0) AS toxic_lost
  FROM s, m GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, l)::BIGINT AS shapley
FROM g
"""
