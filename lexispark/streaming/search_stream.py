"""Answering a stream of query lines against a static dictionary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators.render import json_exact
from lexispark.operators.search import answers, fuzzy
from lexispark.sources.dictionary import parse_query_lines


def answer_batch(lines: DataFrame, words: DataFrame, strategy: str = "auto") -> DataFrame:
    """(qid, json) for lines (qid, value); lines that are no query answer with null. Equal queries of a batch are answered once."""
    parsed = parse_query_lines(lines, strict=False)
    good = parsed.where("corrupt is null").select("qid", F.concat_ws(" ", "max_distance", "word").alias("asked"), "max_distance", "word")
    once = good.select(F.col("asked").alias("qid"), "max_distance", "word").distinct()
    answered = answers(once, fuzzy(once, words, strategy)).select(F.col("qid").alias("asked"), json_exact(F.col("results")).alias("json"))
    return good.select("qid", "asked").join(answered, "asked").select("qid", "json").unionByName(parsed.where("corrupt is not null").select("qid", F.lit(None).cast("string").alias("json")))


def answer_stream(lines: DataFrame, words: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, strategy: str = "auto", available_now: bool = True) -> StreamingQuery:
    """Answer a streaming DataFrame (qid, value) batch by batch; sink gets (answers in qid order, batch id).

    No state is kept between lines, so foreachBatch with the batch plan is enough; a batch that is repeated after a
    failure has the same id and the same answers.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            sink(answer_batch(held, words, strategy).orderBy("qid"), batch_id)
        finally:
            held.unpersist()

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Query lines of the text files that arrive in a folder: each line starts with its qid and a tab."""
    lines = spark.readStream.text(folder, lineSep="\n")
    part = F.split("value", "\t", 2)
    return lines.select(F.get(part, 0).try_cast("bigint").alias("qid"), F.get(part, 1).alias("value"))
