"""A corpus pipeline of the training-data operators, stage by stage over whole tables.

Every stage takes the documents its predecessor kept, with all their columns,
and is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import compression_quality, mixing, ngram_join, simhash_decontamination, token_output
from dayspan.llm.common import documents, saved
from dayspan.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labelled ones, accepts (score of 0.3 and more)."""
    return compression_quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group linked by shingle similarity of 0.8 and more."""
    return ngram_join.deduplicated(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage that matches a benchmark item."""
    return simhash_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, repeated as their source's target asks."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and each document as read back from them. The rows' order
    in their files is the training order; without files it is by doc_id."""
    order: tuple[str, ...] = ("doc_id",)
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        order = ("file", "row")
    except AnalysisException:
        pass  # not read from files
    return token_output.token_output(docs, tokenizer_path(), order=order)


STAGES = [("quality", good_quality), ("near_copies", no_near_copies), ("decontamination", no_benchmark),
          ("mixing", mix_sources), ("tokens", write_tokens)]
#: similarity groups and the trained classifier can't be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
