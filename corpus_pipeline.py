"""A corpus from raw documents: five stages, each over all that the one before kept. Each is written and read again."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import copies, langid, mixing, packing, pii
from orrery.llm._shared import alone, stage
from orrery.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return langid.keep_identified(docs, langid.train(docs.where(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (5-word shingles, Jaccard 0.8 or more) stays: that of the smallest doc_id (nulls last), then the first."""
    rows = stage(docs.withColumn("__or_row", F.monotonically_increasing_id()), "rows")
    named = stage(copies.near_copies(rows.select(F.col("__or_row").alias("row"), "text")).withColumnRenamed("row", "__or_row"), "roots")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__or_row")).alias("first")
    several = named.groupBy("root").count().where("count > 1").select("root")
    members = named.join(several, "root", "left_semi").join(rows.select("__or_row", "doc_id"), "__or_row")
    kept = members.groupBy("root").agg(first).select("first.__or_row")
    gone = stage(members.select("__or_row").join(kept, "__or_row", "left_anti"), "gone")
    return copies.without(rows, gone, "__or_row").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents repeat as the mix takes them."""
    return mixing.materialise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]

#: SQL can't express a trained model, a tokeniser or a genetic algorithm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = alone(partial(step, spark, docs, sf_dir), name)  # what the stage wrote on its way goes
    return docs
