"""Scalar functions. Lengths, distances and order count UTF-8 bytes, so words get a shadow with one character per byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest word plus distance that one 64-bit word of the bit-parallel kernel holds.
KERNEL_BITS = 61


def byte_string(word: Column) -> Column:
    """One character per UTF-8 byte: what levenshtein() and substr() then count are bytes."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def from_byte_string(word: Column) -> Column:
    return F.decode(F.encode(word, "ISO-8859-1"), "UTF-8")


def byte_length(word: Column) -> Column:
    return F.octet_length(word)


def auto_distance(word: Column) -> Column:
    """A distance that suits the length: 1 up to four bytes, one more for every five."""
    return (F.floor(F.octet_length(word) / 5) + 1).cast("int")


def bit_kernel_fits(word: Column, max_distance: Column) -> Column:
    return F.octet_length(word) + max_distance <= KERNEL_BITS


def tokens(line: Column) -> Column:
    """Tokens between runs of any Unicode white space."""
    return F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")


def unsigned(token: Column) -> Column:
    """A whole number of digits (a leading plus sign is allowed), or null."""
    return F.when(token.rlike(r"^\+?[0-9]+$"), token.try_cast("bigint"))
