"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexispark.operators import search
from lexispark.plans import catalog
from lexispark.sources import dictionary
from lexispark.sources.workspace import new_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS, DROP = int(os.environ.get("BENCH_RUNS", "5")), 1
HEADLINE = ["dictionary_build", "exact_lookup_k0", "fuzzy_k1", "fuzzy_k2", "ranked_suggestions", "json_results_exact", "index_information"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    began = time.time()
    action()
    return round(time.time() - began, 3)


def trimmed(action) -> tuple[float, float]:
    """The middle of RUNS timings without the DROP least and greatest, and the largest distance of the rest from it."""
    kept = sorted(timed(action) for _ in range(RUNS))[DROP : RUNS - DROP]
    middle = kept[len(kept) // 2]
    return middle, round(max(abs(t - middle) for t in kept), 3)


def main() -> None:
    spark = session()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    queries: dict[str, float] = {}
    for name in HEADLINE:
        queries[name] = timed(lambda name=name: catalog.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    # Batches of 3000 words of the dictionary against its persisted index, as the published tables have them.
    index = new_path(spark, "bench-index")
    queries["index_write"] = timed(lambda: dictionary.write_index(catalog.corpus_dictionary(spark, SF_DIR), index, 2 * int(CPUS)))
    words = dictionary.read_index(spark, index)
    batch = words.orderBy(F.col("freq").desc(), "word").limit(2250).unionByName(words.orderBy("freq", F.col("word").desc()).limit(750))
    batch = batch.select(catalog.qid_of("word").alias("qid"), "word").persist()
    n = batch.count()
    rates, errors = {}, {}
    for k in (0, 1, 2):
        own = batch.withColumn("max_distance", F.lit(k))
        seconds, errors[f"k{k}"] = trimmed(lambda own=own: search.fuzzy(own, words).write.format("noop").mode("overwrite").save())
        queries[f"batch_3000_k{k}"] = seconds
        rates[f"k{k}"] = round(n / seconds, 1)
    print(json.dumps({"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "queries_per_second": rates, "errors": errors, "runs": RUNS, "dictionary_words": words.count(), "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
