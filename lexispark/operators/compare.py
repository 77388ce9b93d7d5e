"""Tools around searches: query mixes, differences of answers, statistics of timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a mix at most.
MIX_QUERIES = 3000


def query_mix(words: DataFrame, amount: int, head_percent: int, order: list[Column] | None = None, queries: int = MIX_QUERIES) -> DataFrame:
    """(part, word) of a benchmark: of the first `amount` words by `order` (most frequent first), head_percent of
    min(queries, amount) from the head of the whole dictionary, the rest from its tail; a word may be in both parts."""
    order = order or [F.col("freq").desc(), F.col("word")]
    n = min(queries, amount)
    head, tail = head_percent * n // 100, (100 - head_percent) * n // 100
    first = words.orderBy(*order).limit(head).select(F.lit("head").alias("part"), "word")
    back = [F.col("freq").asc(), F.col("word").desc()] if len(order) == 2 else order
    last = words.orderBy(*back).limit(tail).select(F.lit("tail").alias("part"), "word")
    return first.unionByName(last)


def results_diff(left: DataFrame, right: DataFrame, column: str = "results") -> DataFrame:
    """(qid, left, right) where two answers to a query differ, or one lacks; no rows if all are equal."""
    x = left.select("qid", F.col(column).alias("left"), F.lit(True).alias("in_left"))
    y = right.select("qid", F.col(column).alias("right"), F.lit(True).alias("in_right"))
    return x.join(y, "qid", "full").where("in_left is null or in_right is null or not (left <=> right)").select("qid", "left", "right")


def trimmed_stats(timings: DataFrame, group: list[str], value: str = "ms", drop: int = 2) -> DataFrame:
    """Per group: the middle of the timings without the `drop` least and greatest (the upper one of two), and the largest distance of the rest from it."""
    kept = F.expr(f"slice(sort_array(collect_list({value})), {drop + 1}, greatest(count({value}) - {2 * drop}, 0))")
    out = timings.groupBy(*group).agg(kept.alias("kept")).where(F.size("kept") > 0)
    out = out.withColumn("median", F.get("kept", F.floor(F.size("kept") / 2).cast("int")))
    return out.withColumn("error", F.array_max(F.transform("kept", lambda t: F.abs(t - F.col("median"))))).drop("kept")
