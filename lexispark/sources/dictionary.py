"""Dictionaries: text files, corpora, and the persisted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.text import byte_string, tokens, unsigned
from lexispark.schemas import MAX_FREQ


def parse_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """(word, freq) of lines `word frequency ...`; any white space parts tokens, further tokens are ignored.

    strict: the first bad line ends the query with an error. Otherwise there is a third column, corrupt, with bad lines
    (whose word and freq are null). Bad are lines without word or frequency, bytes that are no UTF-8, and frequencies
    that are no whole number from 1 to 4294967295.
    """
    line = F.col(column)
    part = tokens(line)
    word, freq = F.get(part, 0), unsigned(F.get(part, 1))
    bad = ~F.is_valid_utf8(line) | word.isNull() | freq.isNull() | ~freq.between(1, MAX_FREQ)
    bad = F.coalesce(bad, F.lit(True))
    if strict:
        fail = F.raise_error(F.concat(F.lit("bad dictionary line: "), F.coalesce(line, F.lit("null"))))
        return lines.select(F.when(bad, fail.cast("string")).otherwise(word).alias("word"), F.when(bad, F.lit(None)).otherwise(freq).cast("bigint").alias("freq"))
    return lines.select(F.when(~bad, word).alias("word"), F.when(~bad, freq).alias("freq"), F.when(bad, line).alias("corrupt"))


def read_dictionary(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A dictionary file, duplicates resolved. Lines end with a line feed only; a carriage return before it is white space."""
    parsed = parse_lines(spark.read.text(path, lineSep="\n"), strict=strict)
    return dedupe(parsed if strict else parsed.where("corrupt is null").drop("corrupt"))


def dedupe(words: DataFrame) -> DataFrame:
    """One row per word, with its largest frequency (partial aggregates on the map side)."""
    return words.groupBy("word").agg(F.max("freq").alias("freq"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files have fewer splits than there are cores; larger tables stay where they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def corpus_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """Runs of letters of all texts, one row each. The column is selected before rows are spread, so the scan reads no other."""
    return spread(texts.select(F.col(text))).select(F.explode(F.split(F.col(text), r"[^\p{L}]+")).alias("word")).where("word <> ''")


def from_corpus(texts: DataFrame, text: str = "text") -> DataFrame:
    """A dictionary of a corpus: words with their numbers of occurrences."""
    return corpus_tokens(texts, text).groupBy("word").agg(F.count("*").alias("freq"))


def with_bytes(words: DataFrame) -> DataFrame:
    """The derived columns of the index: byte string and byte length."""
    return words.withColumns({"wb": byte_string(F.col("word")), "len": F.octet_length("word")})


def write_index(words: DataFrame, path: str, parts: int | None = None) -> None:
    """Persist a dictionary, sorted by word within ranges so that files' statistics serve exact lookups.

    A search does much work for each byte of an index, so unless parts says otherwise there are as many files as keep all
    cores busy, however few bytes that makes of each.
    """
    spark = words.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with_bytes(dedupe(words)).repartitionByRange(parts, "word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, freq long, wb string, len int").parquet(path)


def deletions(rows: DataFrame, column: str, levels: int) -> DataFrame:
    """rows with `variant`, a hash of the byte string `column` without up to `levels` bytes, and `depth`, how many went.

    Bytes go from left to right, so no two orders of the same deletions come up, and nothing needs to be made distinct:
    this is a map. (Equal neighbours still give equal variants.)
    """
    out = level = rows.withColumns({"_rest": F.col(column), "_from": F.lit(1)})
    out = out.withColumn("depth", F.lit(0))
    for depth in range(1, levels + 1):
        spots = F.when(F.col("_from") <= F.length("_rest"), F.sequence("_from", F.length("_rest"))).otherwise(F.array().cast("array<int>"))
        level = level.withColumn("_at", F.explode(spots))
        level = level.withColumn("_rest", F.concat(F.substr(F.col("_rest"), F.lit(1), F.col("_at") - 1), F.expr("substr(_rest, _at + 1)"))).withColumn("_from", F.col("_at")).drop("_at")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.withColumn("variant", F.xxhash64("_rest")).drop("_rest", "_from")


#: Partitions of a persisted variant index: a few queries read few of them.
VARIANT_PARTS = 64


def write_variants(words: DataFrame, path: str, levels: int) -> None:
    """Persist what approximate search looks up: a row for each word and string that up to `levels` deletions leave, by depth and a part of the variant's hash."""
    d = words if "wb" in words.columns else with_bytes(words)
    rows = deletions(d.select("word", "freq", "wb"), "wb", levels).select("variant", "word", "freq", "depth", F.pmod("variant", F.lit(VARIANT_PARTS)).cast("int").alias("part"))
    rows.repartition(VARIANT_PARTS, "part").sortWithinPartitions("depth", "part", "variant").write.mode("overwrite").partitionBy("depth", "part").parquet(path)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("variant long, word string, freq long, depth int, part int").parquet(path)


def parse_query_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """lines with max_distance and word of `<anything> <distance> <word> ...`. strict as in parse_lines."""
    line: Column = F.col(column)
    part = tokens(line)
    k, word = unsigned(F.get(part, 1)), F.get(part, 2)
    bad = F.coalesce(~F.is_valid_utf8(line) | k.isNull() | word.isNull() | (k > 2147483647), F.lit(True))
    if strict:
        fail = F.raise_error(F.concat(F.lit("bad query line: "), F.coalesce(line, F.lit("null"))))
        return lines.withColumns({"max_distance": F.when(bad, fail.cast("int")).otherwise(k.cast("int")), "word": F.when(~bad, word)})
    return lines.withColumns({"max_distance": F.when(~bad, k.cast("int")), "word": F.when(~bad, word), "corrupt": F.when(bad, line)})


def query_lines(words: DataFrame, max_distance: int, command: str = "approx") -> DataFrame:
    """Query lines for the words of a dictionary."""
    return words.withColumn("value", F.concat_ws(" ", F.lit(command), F.lit(str(max_distance)), F.col("word")))


def read_queries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(qid, max_distance, word) of a file of query lines; qid is the line number, which keeps the order of answers.

    A first pass counts the lines of each partition of the scan; a line's number is its place in its partition and the
    lines of the partitions before. All of it stays in the JVM; one number for each partition is what is broadcast.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", (before - F.col("first")).alias("shift"))
    numbered = lines.join(F.broadcast(offsets), "part").select("value", (F.col("place") + F.col("shift")).alias("qid"))
    return parse_query_lines(numbered, strict=strict).drop("value")
