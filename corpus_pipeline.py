"""A corpus pipeline out of the training-data operators: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents. No stage can be put in SQL as a whole, so ORACLE_SQL is
None; tests compare a run with brute force.

Defined results: documents with null or empty texts pass every stage; rows of equal doc_id are one document, of which one
row stays after the near-duplicate stage; rows without a doc_id pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, common, decontaminate, jaccard, substring, toxicity

ORACLE_SQL = None
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of docs and let documents that score as toxic go."""
    learned = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, learned).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the least doc_id stays."""
    members = common.table(jaccard.jaccard_join(docs)[1].select("doc_id", "component_id"), "members")
    gone = members.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(common.sized(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    again = common.table(members.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"), "again")
    if again.isEmpty():
        return kept
    again = common.sized(again)
    once = kept.join(again, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut from the texts."""
    cut = substring.substring_dedup(docs)
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("not contaminated").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with their number and the digests of ids and decoded bytes."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), keep_text=False).select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
