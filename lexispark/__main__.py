"""Entry points: python -m lexispark MODE ... with the modes of MODES.

compile DICTIONARY INDEX [LEVELS]   a dictionary file to an index (and its variants up to LEVELS deletions)
search INDEX QUERIES ANSWERS        a file of query lines to one JSON line for each
info INDEX                          words, nodes, height, lengths and bytes of the tree that the index amounts to
graph INDEX OUT                     the tree's drawing
bench INDEX [DISTANCE]              queries a second of a mix of frequent and rare words
smoke                               a small dictionary through all of it
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import compare, render, search, tree
from lexispark.sources import dictionary
from lexispark.sources.workspace import new_path


def compile_index(spark: SparkSession, source: str, path: str, levels: str = "0") -> None:
    dictionary.write_index(dictionary.read_dictionary(spark, source), f"{path}/words")
    if int(levels):
        dictionary.write_variants(dictionary.read_index(spark, f"{path}/words"), f"{path}/variants-{levels}", int(levels))


def answer(spark: SparkSession, path: str, queries: str, out: str) -> None:
    asked = dictionary.read_queries(spark, queries)
    render.write_answers(search.answers(asked, search.fuzzy(asked, dictionary.read_index(spark, f"{path}/words"))), out)


def info(spark: SparkSession, path: str) -> DataFrame:
    words = dictionary.read_index(spark, f"{path}/words")
    found = tree.information(words).crossJoin(F.broadcast(tree.index_bytes(words)))  # one row each
    found.show(truncate=False)
    return found


def graph(spark: SparkSession, path: str, out: str) -> None:
    tree.write_dot(dictionary.read_index(spark, f"{path}/words"), out)


def bench(spark: SparkSession, path: str, distance: str = "1", runs: int = 10) -> DataFrame:
    """Middle and error in milliseconds of a mix of queries, by the trimmed statistics."""
    words = dictionary.read_index(spark, f"{path}/words")
    mix = compare.query_mix(words, 100_000, 75).select(F.monotonically_increasing_id().alias("qid"), F.lit(int(distance)).alias("max_distance"), "word").persist()
    timings = []
    for _ in range(runs):
        began = time.time()
        search.fuzzy(mix, words).write.format("noop").mode("overwrite").save()
        timings.append((int(distance), int(1000 * (time.time() - began))))
    found = compare.trimmed_stats(spark.createDataFrame(timings, "distance int, ms long"), ["distance"])
    found.show(truncate=False)
    return found


def smoke(spark: SparkSession) -> DataFrame:
    """Matches of a misspelt word in a dictionary of three."""
    path = new_path(spark, "smoke")
    dictionary.write_index(spark.createDataFrame([("hello", 10), ("help", 5), ("world", 1)], "word string, freq long"), f"{path}/words")
    found = search.fuzzy(spark.createDataFrame([(0, 1, "helo")], "qid long, max_distance int, word string"), dictionary.read_index(spark, f"{path}/words"))
    found.show(truncate=False)
    return found


MODES = {"compile": compile_index, "search": answer, "info": info, "graph": graph, "bench": bench, "smoke": smoke}


def main(arguments: list[str]) -> None:
    if not arguments or arguments[0] not in MODES:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName(f"lexispark {arguments[0]}").getOrCreate()
    MODES[arguments[0]](spark, *arguments[1:])
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
