"""Exact and approximate lookup.

The distances of a batch of queries decide the plan. Distance 0 is an equi-join. For distances up to 3, both sides emit
hashes of the strings that up to k deletions leave, and equal ones meet (plan "variants": the batch's are broadcast while
they are few, so the dictionary is only mapped over, or a persisted index of its variants is read). A
small batch is cheaper the other way: each query is broadcast under every length it can match and meets the dictionary
on length ("lengths"). For larger distances, words are cut into 2k + 1 segments, one of which an edit path of k steps
leaves whole, and segments meet substrings of the query at most k places off ("segments"); words too short for that are
cut into k // 2 + 1, one of which holds one edit at most, and only the shortest meet on length. All candidates are verified by the same guarded distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.osa import within, within_arrow
from lexispark.functions.text import byte_string
from lexispark.sources.dictionary import VARIANT_PARTS, deletions, with_bytes

#: Queries of a batch up to which lengths are broadcast instead of expanding the dictionary.
SMALL_BATCH = 200
#: Distances up to which variants are made, and least bytes of a segment for larger ones.
MOST_DELETIONS, SEGMENT_BYTES = 3, 3
#: Rows of the queries' side of a join up to which it is broadcast, after being counted.
BROADCAST_ROWS = 1_000_000
COLUMNS = ["qid", "max_distance", "query", "word", "freq", "distance"]


def _prepared(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.col("max_distance").cast("int").alias("max_distance"), F.col("word").alias("query"), byte_string(F.col("word")).alias("qb"))


def _indexed(words: DataFrame) -> DataFrame:
    return words if {"wb", "len"} <= set(words.columns) else with_bytes(words)


def exact(queries: DataFrame, words: DataFrame) -> DataFrame:
    """At most one row for a query: the word itself."""
    q = queries.select("qid", F.col("max_distance").cast("int").alias("max_distance"), F.col("word").alias("query"))
    found = q.join(words.select("word", "freq"), F.col("query") == F.col("word"))
    return found.withColumn("distance", F.lit(0)).select(COLUMNS)


def _verify(candidates: DataFrame, arrow: bool = False) -> DataFrame:
    """Candidates within their distance. arrow: for plans that leave many candidates to the table."""
    if arrow:
        return within_arrow(candidates, "qb", "wb", "max_distance", "query", "word").select(COLUMNS)
    judged = candidates.withColumn("distance", within(F.col("qb"), F.col("wb"), F.col("max_distance")))
    return judged.where("distance is not null").select(COLUMNS)


def _small(queries: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The queries' side of a join, marked for broadcast if it has at most so many rows (it is counted); otherwise the join shuffles."""
    return F.broadcast(queries) if queries.count() <= rows else queries


def by_variants(queries: DataFrame, words: DataFrame, k: int, variants: DataFrame | None = None) -> DataFrame:
    """Candidates that share a string left by up to k deletions; queries of distance up to k.

    The dictionary's variants come from a persisted index, or are made on the way (a map over the dictionary). They meet
    the batch's variants, which are broadcast while they are few.
    """
    q = deletions(_prepared(queries), "qb", k).drop("depth").withColumnRenamed("variant", "v")
    if variants is None:
        d = deletions(_indexed(words).select("word", "freq", "wb"), "wb", k)
        met = d.join(_small(q), F.col("variant") == F.col("v"))
    else:
        q = q.withColumn("p", F.pmod("v", F.lit(VARIANT_PARTS)).cast("int"))
        met = variants.where(F.col("depth") <= k).join(_small(q), (F.col("variant") == F.col("v")) & (F.col("part") == F.col("p"))).withColumn("wb", byte_string(F.col("word")))
    near = met.where((F.abs(F.length("qb") - F.length("wb")) <= k) & (F.levenshtein("qb", "wb") <= 2 * k))
    pairs = near.select("qid", "max_distance", "query", "qb", "word", "freq", "wb").dropDuplicates(["qid", "word"])
    return _verify(pairs, arrow=k > 1)


def by_lengths(queries: DataFrame, words: DataFrame, arrow: bool = False) -> DataFrame:
    """Candidates by length: each query stands under every length within its distance, and goes to the dictionary."""
    q = _prepared(queries).withColumn("len", F.explode(F.sequence(F.greatest(F.length("qb") - F.col("max_distance"), F.lit(0)), F.length("qb") + F.col("max_distance"))))
    if not arrow:
        return _verify(_indexed(words).join(_small(q), "len"))
    met = _with_letters(_indexed(words), "wb", "w").join(_small(_with_letters(q, "qb", "q")), "len")
    return _verify(met.where(_near(F.col("max_distance"))), arrow=True)


def _segment(text: Column, k: Column, length: Column, s: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment s of 2k + 1 even ones."""
    n = 2 * k + 1
    a, b = F.floor(s * length / n), F.floor((s + 1) * length / n)
    return a.cast("int"), (b - a).cast("int")


def _with_letters(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with two sets of 64 bits: the bytes (by their remainder) that the byte string has, and those that it has twice."""
    empty = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    add = lambda x, i: F.struct(x["once"].bitwiseOR(_bit(F.col(column), i)).alias("once"), x["twice"].bitwiseOR(x["once"].bitwiseAND(_bit(F.col(column), i))).alias("twice"))
    sets = F.when(F.length(column) > 0, F.aggregate(F.sequence(F.lit(1), F.length(column)), empty, add)).otherwise(empty)
    return rows.withColumn("_sets", sets).withColumns({f"{name}1": F.col("_sets")["once"], f"{name}2": F.col("_sets")["twice"]}).drop("_sets")


def _bit(text: Column, i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(F.substr(text, i, F.lit(1))) % 64)


def _near(k: Column) -> Column:
    """Whether letters and plain distance leave a chance: of k steps, t transpositions are 2t plain edits and leave the letters alone; each other step is one, and adds and takes one letter at most."""
    lacks = lambda a, b: F.bit_count(F.col(f"{a}1").bitwiseAND(F.bitwise_not(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseAND(F.bitwise_not(f"{b}2")))
    apart = F.greatest(lacks("w", "q"), lacks("q", "w"))
    return F.when((apart <= k) & (F.abs(F.length("qb") - F.length("wb")) <= k), F.levenshtein("qb", "wb") <= 2 * k - apart).otherwise(False)


def _one_edit_keys(words: DataFrame, k: int, parts: int) -> DataFrame:
    """(key, word, freq, wb): hashes of what up to one deletion leaves of each segment, also of a segment whose end is swapped with its neighbour's."""
    d = words.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    a, n = _part(F.col("len"), F.col("s"), parts)
    d = d.withColumn("piece", F.substr(F.col("wb"), a + 1, n))
    first, last, size = F.col("s") == 0, F.col("s") == parts - 1, F.length("piece")
    left = lambda x: F.concat(F.substr(F.col("wb"), a, F.lit(1)), F.substr(x, F.lit(2), size))
    right = lambda x: F.concat(F.substr(x, F.lit(1), size - 1), F.substr(F.col("wb"), a + n + 1, F.lit(1)))
    piece = F.col("piece")
    kinds = F.array(piece, F.when(first, piece).otherwise(left(piece)), F.when(last, piece).otherwise(right(piece)), F.when(first | last, piece).otherwise(right(left(piece))))
    d = d.withColumn("piece", F.explode(F.array_distinct(kinds)))
    return deletions(d, "piece", 1).select(F.xxhash64("len", "s", "variant").alias("key"), "word", "freq", "wb", "w1", "w2")


def _part(length: Column, s: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment s of so many even ones."""
    a, b = F.floor(s * length / parts), F.floor((s + 1) * length / parts)
    return a.cast("int"), (b - a).cast("int")


def _one_edit_spots(queries: DataFrame, k: int, parts: int, shortest: int, longest: int) -> DataFrame:
    """(key, qid) of what up to one deletion leaves of the substrings that can stand against a segment with one edit at most."""
    size = F.length("qb")
    q = queries.where((size >= shortest - k) & (size <= longest + k)).select("qid", "qb")
    q = q.withColumn("len", F.explode(F.sequence(F.greatest(size - k, F.lit(shortest)), F.least(size + k, F.lit(longest)))))
    q = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    a, n = _part(F.col("len"), F.col("s"), parts)
    q = q.withColumns({"a": a, "n": n}).withColumn("off", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn("more", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    q = q.withColumns({"at": F.col("a") + F.col("off"), "m": F.col("n") + F.col("more")}).withColumn("rest", size - F.col("at") - F.col("m"))
    # Lengths before, in and after the segment differ by edits of their own.
    ends = ((F.col("s") > 0) | (F.col("at") == 0)) & ((F.col("s") < parts - 1) | (F.col("rest") == 0))
    q = q.where(ends & (F.col("at") >= 0) & (F.col("rest") >= 0) & (F.abs("off") + F.abs("more") + F.abs(F.col("rest") - (F.col("len") - F.col("a") - F.col("n"))) <= k))
    q = q.select("qid", "len", "s", F.substr(F.col("qb"), F.col("at") + 1, F.col("m")).alias("piece"))
    return deletions(q, "piece", 1).select(F.xxhash64("len", "s", "variant").alias("key"), "qid").distinct()


def by_one_edit_segments(queries: DataFrame, words: DataFrame, k: int, shortest: int, longest: int) -> DataFrame:
    """Pairs that may match, of words from shortest to longest, by k // 2 + 1 segments, one of which holds one edit at most.

    A transposition of the bytes around a cut would be an edit on both sides of it, so segments stand also with that swap
    undone. Queries are met by number, and only their numbers are in the table of keys.
    """
    parts = k // 2 + 1
    q = _prepared(queries)
    d = words.where(F.col("len").between(shortest, longest)).select("word", "freq", "wb", "len")
    met = _one_edit_keys(_with_letters(d, "wb", "w"), k, parts).join(_small(_one_edit_spots(q, k, parts, shortest, longest)), "key")
    return met.join(_small(_with_letters(q, "qb", "q")), "qid").where(_near(F.lit(k)))


def by_segments(queries: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """Candidates that share one of 2k + 1 segments, up to k places off; words whose segments would be shorter than
    SEGMENT_BYTES tell too little apart and are cut into fewer, of which one holds an edit at most. Only words too short for
    that, too, meet on length."""
    least, shortest = SEGMENT_BYTES * (2 * k + 1), SEGMENT_BYTES * (k // 2 + 1)
    kk = F.lit(k)
    d = _indexed(words)
    long = d.where(F.col("len") >= least).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2 * k))))
    a, n = _segment(F.col("wb"), kk, F.col("len"), F.col("s"))
    long = long.withColumn("piece", F.substr(F.col("wb"), a + 1, n))
    q = _prepared(queries)
    spots = q.withColumn("len", F.explode(F.sequence(F.greatest(F.length("qb") - k, F.lit(least)), F.greatest(F.length("qb") + k, F.lit(least)))))
    spots = spots.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2 * k)))).withColumn("off", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    a, n = _segment(F.col("qb"), kk, F.col("len"), F.col("s"))
    spots = spots.withColumn("at", a + F.col("off")).withColumn("n", n).where("at >= 0 and at + n <= length(qb)")
    spots = spots.select("qid", "max_distance", "query", "qb", "len", "s", F.substr(F.col("qb"), F.col("at") + 1, F.col("n")).alias("piece")).distinct()
    met = long.select("len", "s", "piece", "word", "freq", "wb").join(_small(spots), ["len", "s", "piece"])
    columns = ["qid", "max_distance", "query", "qb", "word", "freq", "wb"]
    near = met.where(F.levenshtein("qb", "wb") <= 2 * k).select(columns)
    near = near.unionByName(by_one_edit_segments(queries, d, k, shortest, least - 1).select(columns))
    pairs = near.dropDuplicates(["qid", "word"])
    return _verify(pairs, arrow=True).unionByName(by_lengths(queries, d.where(F.col("len") < shortest), arrow=True))


def fuzzy(queries: DataFrame, words: DataFrame, strategy: str = "auto", variants: DataFrame | None = None) -> DataFrame:
    """All words within each query's own distance: (qid, max_distance, query, word, freq, distance).

    queries: (qid, max_distance, word), qid unique; words: (word, freq), words unique, or a read index. strategy: auto,
    variants, lengths or segments. variants: a persisted variant index of the words, of as many levels as the largest
    distance that is to use it. The distances in use are read first (a handful of numbers) and give one branch each.
    """
    words = _indexed(words)
    sizes = sorted((r.max_distance, r["count"]) for r in queries.where("max_distance >= 0").groupBy("max_distance").count().collect())
    branches = []
    for k, n in sizes:
        own = queries.where(F.col("max_distance") == k)
        if k == 0:
            branches.append(exact(own, words))
        elif strategy == "lengths" or strategy == "auto" and n <= SMALL_BATCH and variants is None:
            branches.append(by_lengths(own, words, arrow=k > 1))
        elif strategy == "segments" or k > MOST_DELETIONS and strategy == "auto":
            branches.append(by_segments(own, words, k))
        else:
            branches.append(by_variants(own, words, k, variants))
    if not branches:
        return exact(queries.limit(0), words)
    out = branches[0]
    for more in branches[1:]:
        out = out.unionByName(more)
    return out


def ranked(matches: DataFrame) -> DataFrame:
    """matches with rank: by distance, then larger frequency, then the word's bytes."""
    order = Window.partitionBy("qid").orderBy(F.col("distance"), F.col("freq").desc(), F.col("word"))
    return matches.withColumn("rank", F.row_number().over(order))


def answers(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """(qid, max_distance, query, results) for every query, in results' order; without a match results is empty."""
    packed = F.array_sort(F.collect_list(F.struct("distance", (-F.col("freq")).alias("minus"), "word")))
    lists = matches.groupBy("qid").agg(packed.alias("packed"))
    lists = lists.select("qid", F.transform("packed", lambda r: F.struct(r["word"].alias("word"), (-r["minus"]).alias("freq"), r["distance"].alias("distance"))).alias("results"))
    empty = F.array().cast("array<struct<word: string, freq: bigint, distance: int>>")
    return queries.select("qid", "max_distance", F.col("word").alias("query")).join(lists, "qid", "left").withColumn("results", F.coalesce("results", empty))


def unmatched(queries: DataFrame, words: DataFrame) -> DataFrame:
    """An extension: queries whose word the dictionary lacks."""
    return queries.join(words.select("word"), "word", "left_anti")


def suggestions(matches: DataFrame, n: int) -> DataFrame:
    """An extension: the first n matches of each query."""
    return ranked(matches).where(F.col("rank") <= n)
