"""The corpus pipeline: documents of good quality, without near-copies, benchmark passages and secrets, as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import contamination, near_duplicates, pieces, quality, secret_scan
from depweave.llm.common import fresh, small_batches, table, trainable
from depweave.plans.staging import stage, unstage

#: What the stages do is not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on labels that may be learnt, rejects."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(trainable(F.col("doc_id")))
    return quality.keep(docs, quality.fit(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies, that of the least id."""
    small_batches(spark)
    return near_duplicates.drop_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    small_batches(spark)
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows where a text changed."""
    small_batches(spark)
    before = fresh(docs, "before")
    marked = secret_scan.redact(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        changed = F.length("text") - F.col(before)
        marked = marked.withColumn("n_chars", F.when(changed != 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids in place of the text."""
    small_batches(spark)
    coded = pieces.encode(docs, pieces.vocabulary(spark))
    return coded.withColumn("n_ids", F.size("ids").cast("long")).drop("text")


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", as_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return apply(spark, docs, sf_dir)
        done = stage(apply(spark, docs, sf_dir), name)
        if k:
            unstage(docs)
        docs = done
    return docs
