"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's exponential key is -ln(u) / weight with u drawn from its id, text and source, and from its number among
the rows that are equal in these, so that better documents tend to come first and each row has a draw of its own.
The weight is learned from quality labels: the share of label 1 among the labelled documents that are alike in symbols,
length and word length. Within a source the documents are sorted by key and prefix-summed to the source's token budget:
complete epochs come first, the rest of the budget is a fractional selection by key. Only per-source totals, a
histogram of keys and the bin that holds a source's cut are ever sorted, so a hot source is never one task's work;
texts are read once, and the decision itself is a comparison with the source's cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ranked
from .common import WORD, drop, materialize, table, unused

#: No source is repeated more often than this.
EPOCHS = 3
SEED = 17
#: Documents that one bin of a source's key histogram holds, about.
BIN = 2000
#: Rows of a table with one row a source that are broadcast at most.
BROADCAST_ROWS = 100_000


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str]) -> DataFrame:
    """(doc, id, src, size, alike, own, at): the columns carry, id as text, source, words, what the quality weight looks
    at, a hash of id, text and source, and the task that read the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.col(id_col).cast("string")
    own = F.md5(F.concat_ws(":", F.coalesce(id_, F.lit("")), F.md5(text.cast("binary")), F.coalesce(F.col(source_col), F.lit(""))).cast("binary"))
    src = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias(unused(carry, "last"))).alias("doc"), id_.alias("id"), src.alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>!]")).alias("marks"), F.char_length(text).alias("chars"), own.alias("own"), F.spark_partition_id().alias("at"),
    )
    words = F.greatest("size", F.lit(1))
    # tenths of symbols for each word, halves of log length, characters for each word
    alike = F.struct(F.least(F.floor(10 * F.col("marks") / words), F.lit(20)).alias("a"), F.floor(2 * F.log(words.cast("double"))).alias("b"), F.least(F.floor(F.col("chars") / words), F.lit(30)).alias("c"))
    return df.select("doc", "id", "src", "size", "own", "at", alike.alias("alike"))


def numbered(rows: DataFrame, again: DataFrame, stored: bool) -> DataFrame:
    """rows with tie added: a row's number among the rows of the same own. again: the own of several rows.

    Only rows that have equals are numbered, by the task that read them, so that no group of equals is one task's work.
    stored: rows is a table, which another takes the place of if there are equals.
    """
    n = again.count()
    if n:
        near = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
        same = rows.join(near(again), "own")
        # another reading may deal the rows to other tasks
        same = same if stored else materialize(same)
        upto = Window.partitionBy("own").orderBy("at")
        before = same.groupBy("own", "at").count().withColumn("before", F.sum("count").over(upto) - F.col("count")).drop("count")
        same = same.withColumn("nth", F.row_number().over(Window.partitionBy("own", "at").orderBy("size"))).join(before, ["own", "at"])
        same = same.withColumn("tie", F.col("before") + F.col("nth") - 1).drop("before", "nth")
        out = rows.join(near(again), "own", "left_anti").withColumn("tie", F.lit(0).cast("long")).unionByName(same)
        if stored:
            out = materialize(out)
            drop(rows)
        return out
    out = rows.withColumn("tie", F.lit(0).cast("long"))
    if stored:
        out._scratch = rows._scratch
    return out


def drawn(rows: DataFrame, seed: int) -> DataFrame:
    """rows, numbered, with e added: -ln(u)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", "own", F.lit(seed), "tie").cast("binary")), 1, 13), 16, 10).cast("double")
    return rows.withColumn("e", -F.log((bits + 0.5) / float(1 << 52)))


def weights(rows: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame | None:
    """(alike, weight): for each kind of document the share of label 1 among its labelled ones, with two rows of the
    overall share added; kinds are some thousands at most. Of an id with several labels the largest counts."""
    if labels is None:
        return None
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    seen = rows.select("id", "alike").join(known, "id").groupBy("alike").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    seen = materialize(seen)
    share = seen.agg((F.sum("ones") + 1.0) / (F.sum("n") + 2.0)).first()[0]
    return seen.select("alike", ((F.col("ones") + 2.0 * (0.5 if share is None else share)) / (F.col("n") + 2.0)).alias("weight"))


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Targets from (src, total, ...): sources by code point, null last, weigh 1, 2, 3, repeating.

    No target exceeds epochs times its source's size; the excess is shared anew by weight (water filling), in rounds
    that each fix the sources found full.
    """
    s = ranked(sizes, "src", "place").withColumn("w", (F.col("place") % 3 + 1).cast("double")).withColumn("cap", (epochs * F.col("total")).cast("double"))
    s = materialize(s)
    level, full = 0.0, -1
    while True:
        fits = F.col("cap") < F.lit(level) * F.col("w")
        r = s.agg(F.sum("total"), F.sum(F.when(fits, F.col("cap")).otherwise(0.0)), F.sum(F.when(fits, 0.0).otherwise(F.col("w"))), F.count(F.when(fits, 1))).first()
        if not r[0] or not r[2] or r[3] == full:
            break
        level, full = (r[0] - r[1]) / r[2], r[3]
    return s.withColumn("target", F.least(F.lit(level) * F.col("w"), F.col("cap"))).drop("cap", "place", "w")


def mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: int = SEED, carry: list[str] | None = None, stored: bool = True) -> DataFrame:
    """The columns carry of docs (all by default) with size, source_size, target, taken and copies added (columns of those names are replaced).

    copies is how often the mix takes the document, taken that many times its words. Documents of no words, null
    texts among them, come with the complete epochs. Rows that repeat an id, or have none, are taken one by one; which
    of the rows that are equal in id, text and source is left open. A null source is a source of its own, the last.
    Reruns agree: keys depend on ids, texts, sources and labels only.
    Without labels all documents weigh the same. The columns carry lie in a table until the result is used no more, or,
    if they are not to be stored, docs is read again for the result; then only rows that have equals are.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("size", "source_size", "target", "taken", "copies")]
    own = materialize(keyed(docs, id_col, text_col, source_col, keep if stored else []))
    again = materialize(own.groupBy("own").count().filter("count > 1").select("own"))
    own = numbered(own, again, True)
    learned = weights(own, labels)
    other = None if learned is None else learned.agg(F.avg("weight")).first()[0]

    def ordered(rows: DataFrame) -> DataFrame:
        rows = drawn(rows, seed)
        if learned is None:
            rows = rows.withColumn("weight", F.lit(1.0))
        else:
            rows = rows.join(F.broadcast(learned), "alike", "left").fillna(0.5 if other is None else other, ["weight"])
        return rows.withColumn("key", F.col("e") / F.col("weight"))

    rows = ordered(own)
    sizes = rows.groupBy("src").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.avg("weight").alias("mean"))
    plan = targets(sizes, epochs)
    plan = plan.withColumn("rounds", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("rounds") * F.col("total")).withColumn("bins", F.ceil(F.col("n") / BIN))
    plan = materialize(plan)
    near = F.broadcast if plan.count() <= BROADCAST_ROWS else lambda df: df
    bin_ = F.least(F.floor(F.col("bins") * (1 - F.exp(-F.col("key") * F.col("mean")))), F.col("bins") - 1)
    binned = rows.join(near(plan.select("src", "bins", "mean", "rest")), "src").withColumn("bin", bin_)
    sums = binned.groupBy("src", "rest", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("src").orderBy("bin")
    sums = sums.withColumn("past", F.sum("words").over(upto)).withColumn("before", F.col("past") - F.col("words"))
    edge = materialize(sums.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("past"))).select("src", F.col("bin").alias("edge"), "before"))
    # only a source's cut bin, some BIN rows, is sorted
    cut = binned.join(near(edge), "src").filter(F.col("bin") == F.col("edge"))
    run = Window.partitionBy("src").orderBy("key", "own", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("upto", F.col("before") + F.sum("size").over(run))
    place = F.struct("key", "own", "tie")
    cut = cut.filter(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("src").agg(F.max(place).alias("last"))
    cut = edge.join(cut, "src", "left")
    plan = materialize(plan.join(cut, "src", "left").select("src", F.col("total").alias("source_size"), "target", "rounds", "bins", "mean", "edge", "last", F.col("edge").isNull().alias("all")))
    if not stored:
        drop(own)
        rows = ordered(numbered(keyed(docs, id_col, text_col, source_col, keep), again, False))
    else:
        drop(again)
    out = rows.join(near(plan), "src").withColumn("at", bin_)
    extra = F.when(F.col("all"), False).when(F.col("at") != F.col("edge"), F.col("at") < F.col("edge")).otherwise(F.coalesce(place <= F.col("last"), F.lit(False)))
    out = out.withColumn("copies", F.col("rounds") + extra.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    drop(edge)
    return out.select(*[F.col(f"doc.`{c}`") for c in keep], "size", "source_size", "target", "taken", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


#: Over a table named {docs}; the cut is found by one running sum over each source's keys.
MIX_SQL = """
WITH k AS (
  SELECT d.*, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size_,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) AS marks_, length(coalesce(text, '')) AS chars_,
         CAST('0x' || substr(md5(own_ || ':{seed}:' || (row_number() OVER (PARTITION BY own_) - 1)), 1, 13) AS BIGINT) AS bits_
  FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, '')) AS own_ FROM {docs}) d
), f AS (
  SELECT *, least(floor(10 * marks_ / greatest(size_, 1)), 20) AS a_, floor(2 * ln(greatest(size_, 1)::DOUBLE)) AS b_, least(floor(chars_ / greatest(size_, 1)), 30) AS c_
  FROM k
), y AS (SELECT doc_id, max(quality) AS y_ FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
q AS (SELECT a_, b_, c_, count(*) AS n_, sum(y_) AS ones_ FROM f JOIN y USING (doc_id) GROUP BY ALL),
g AS (SELECT a_, b_, c_, (ones_ + 2.0::DOUBLE * (SELECT (sum(ones_) + 1.0::DOUBLE) / (sum(n_) + 2.0::DOUBLE) FROM q)) / (n_ + 2.0::DOUBLE) AS weight_ FROM q),
e AS (
  SELECT f.*, -ln((bits_ + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(weight_, (SELECT avg(weight_) FROM g)) AS key_,
         source IS NULL AS none_, coalesce(source, '') AS name_
  FROM f LEFT JOIN g USING (a_, b_, c_)
), s AS (SELECT none_, name_, sum(size_)::BIGINT AS total_ FROM e GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY none_, name_) - 1) % 3 + 1)::DOUBLE AS w_, ({epochs} * total_)::DOUBLE AS cap_ FROM s),
l AS (
  SELECT *, (sum(total_) OVER () - coalesce(sum(cap_) OVER (ORDER BY cap_ / w_, none_, name_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w_) OVER (ORDER BY cap_ / w_, none_, name_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_
  FROM w
), t AS (
  SELECT none_, name_, total_, least(coalesce(max(level_) FILTER (WHERE level_ * w_ <= cap_) OVER (), 0) * w_, cap_) AS target_ FROM l
), p AS (
  SELECT *, CASE WHEN total_ > 0 THEN floor(target_ / total_) ELSE 0 END AS rounds_ FROM t
), r AS (
  SELECT e.*, total_, target_, rounds_,
         sum(size_) OVER (PARTITION BY none_, name_ ORDER BY key_, own_, bits_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size_ / 2.0 <= target_ - rounds_ * total_ AS extra_
  FROM e JOIN p USING (none_, name_)
)
"""
SQL = MIX_SQL.format(docs="documents", seed=SEED, epochs=EPOCHS) + """
SELECT doc_id, size_::BIGINT AS size, total_ AS source_size, target_ AS target,
       CAST((rounds_ + CASE WHEN target_ > rounds_ * total_ AND extra_ THEN 1 ELSE 0 END) * size_ AS BIGINT) AS taken
FROM r
"""
