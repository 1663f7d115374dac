"""The corpus pipeline: a documents table through five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockgraph.llm import decontamination, mixing, near_dedup, quality_classifier, token_output
from blockgraph.llm.common import materialize, table, unused


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives label 1; the others go."""
    model = quality_classifier.train(quality_classifier.sample(docs, table(spark, sf_dir, "labels")))
    score = unused(docs.columns, "__score")
    return quality_classifier.score(docs, model, out_col=score).filter(F.col(score) >= 0.5).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least id (five-word shingles, similarity 0.8)."""
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item within its error budget."""
    leaks = unused(docs.columns, "__leaks")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), out_col=leaks).filter(F.size(leaks) == 0).drop(leaks)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    # as a struct, so that the operator's columns replace none of docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text", "source")
    out = mixing.mix(whole, table(spark, sf_dir, "labels"), carry=["__doc"], stored=False)
    return out.filter("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places and digests in the token files; a document taken repeatedly stands there as often."""
    return token_output.encode(docs)


STAGES = [("quality classifier", classify), ("near-dedup", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("token output", tokens)]
#: The classifier's training is no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
