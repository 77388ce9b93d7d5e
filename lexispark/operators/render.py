"""Answers as JSON lines, in two forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_exact(results: Column) -> Column:
    """`[{"word":"w","freq":1,"distance":0},...]` byte for byte, nothing escaped."""
    item = lambda r: F.concat(F.lit('{"word":"'), r["word"], F.lit('","freq":'), r["freq"].cast("string"), F.lit(',"distance":'), r["distance"].cast("string"), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(results, item), ","), F.lit("]"))


def json_valid(results: Column) -> Column:
    """The same keys in the same order, with what JSON needs escaped."""
    return F.to_json(results)


def write_answers(answered: DataFrame, path: str, exact: bool = True) -> None:
    """One line per query in the order of qid."""
    lines = answered.orderBy("qid").select((json_exact if exact else json_valid)(F.col("results")).alias("value"))
    lines.write.mode("overwrite").text(path, lineSep="\n")
