"""A corpus pipeline over ``documents``: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents; ``run`` writes what a stage returns as
Parquet in the shared folder and gives it to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import mixing, secrets, toxicity
from lodeframe.llm.decontaminate import without_contaminated
from lodeframe.llm.scratch import cut, discard, is_held_out, table
from lodeframe.llm.simhash import simhash_groups


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is 0.5 or more. Rows with a null id are scored like any other."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out("doc_id"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each SimHash component; of rows that repeat that id, the first by text and then by the other
    columns in order, nulls first. Rows with a null id stay, whatever their texts; null and empty texts are copies of each other."""
    first = simhash_groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_lodeframe_first")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("_lodeframe_first"), "left_semi")
    rest = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    one = kept.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_lodeframe_row")).select("doc_id", *[F.col(f"_lodeframe_row.{c}").alias(c) for c in rest])
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold half or more of a benchmark item in tiles of five words or more. Null and empty texts,
    and rows with a null id, stay; of rows that repeat an id, all go if one does. An empty benchmark rejects nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and its length set anew where any was."""
    return secrets.redacted(docs).withColumn("n_chars", F.when(F.contains("text", F.lit(secrets.MASK)), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have tempered shares. Null values of these are values
    of their own; documents without words have no weight and go; rows that repeat an id stay or go together, and so do all
    rows with a null id."""
    return mixing.sampled(docs, slack=0.01)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: Learnt models and Viterbi decoding have no SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; only the last one's table stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
