"""Restricted Damerau-Levenshtein (optimal string alignment) distance of byte strings.

Deletion, insertion, substitution and transposition of neighbours cost one each, and no part is edited twice. Three
forms of one function: a Catalyst expression (`osa`), which stays in the JVM; an Arrow kernel over batches of pairs
(`osa_arrow`), and plain Python (`osa_python`), which the tests hold both against.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

FAR = 1_000_000


def _char(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1))


def _next_row(a: Column, b: Column, state: Column, i: Column) -> Column:
    """Row i of the table from rows i-1 (state.p1) and i-2 (state.p2)."""

    def cell(row: Column, j: Column) -> Column:
        x, y = _char(a, i), _char(b, j)
        swapped = (i > 1) & (j > 1) & (x == _char(b, j - 1)) & (_char(a, i - 1) == y)
        return F.concat(
            row,
            F.array(
                F.least(
                    F.element_at(state["p1"], j + 1) + 1,
                    F.element_at(row, -1) + 1,
                    F.element_at(state["p1"], j) + F.when(x == y, 0).otherwise(1),
                    F.when(swapped, F.element_at(state["p2"], j - 1) + 1).otherwise(FAR),
                )
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)


def _rows(a: Column, b: Column, finish) -> Column:
    first = F.sequence(F.lit(0), F.length(b))
    start = F.struct(first.alias("p2"), first.alias("p1"), F.array(F.lit(0)).alias("least"), F.array(F.length(b)).alias("last"))

    def step(state: Column, i: Column) -> Column:
        row = _next_row(a, b, state, i)
        return F.struct(state["p1"].alias("p2"), row.alias("p1"), F.concat(state["least"], F.array(F.array_min(row))).alias("least"), F.concat(state["last"], F.array(F.element_at(row, -1))).alias("last"))

    return F.aggregate(F.sequence(F.lit(1), F.length(a)), start, step, finish)


def osa(a: Column, b: Column) -> Column:
    """Distance of two byte strings; null if one is null."""
    whole = _rows(a, b, lambda s: F.element_at(s["p1"], -1))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(whole).cast("int")


def row_minima(a: Column, b: Column) -> Column:
    """Least value of each row 0..length(a): once it exceeds a distance, no continuation of a comes within it."""
    flat = F.transform(F.sequence(F.lit(0), F.length(a)), lambda i: i)
    return F.when(F.length(a) == 0, F.array(F.lit(0))).when(F.length(b) == 0, flat).otherwise(_rows(a, b, lambda s: s["least"]))


def prefix_distances(a: Column, b: Column) -> Column:
    """Distances of b to a's prefixes of 0, 1, ... bytes: what feeding a byte by byte would report after each."""
    flat = F.transform(F.sequence(F.lit(0), F.length(a)), lambda i: i)
    return F.when(F.length(a) == 0, F.array(F.length(b))).when(F.length(b) == 0, flat).otherwise(_rows(a, b, lambda s: s["last"]))


def _cheap(a: Column, b: Column, k: Column) -> tuple[Column, Column]:
    """(possible, decided): whether lengths and plain distance leave a chance, and the distance where the plain one decides it (null where the table must)."""
    plain = F.levenshtein(a, b)
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    # Of k steps at least plain - k are transpositions, which leave the letters alone; each other step moves the sorted letters by two plain edits at most.
    moved = F.levenshtein(letters(a), letters(b))
    possible = (F.abs(F.length(a) - F.length(b)) <= k) & (plain <= 2 * k) & ((plain <= k) | (moved <= 2 * (2 * k - plain)))
    # Two plain edits are one step only as a transposition.
    decided = F.when(plain <= 1, plain).when((plain == 2) & ((F.length(a) != F.length(b)) | (moved > 0)), 2)
    return possible, decided


def within(a: Column, b: Column, k: Column) -> Column:
    """Distance if it is at most k, else null. CASE keeps the table behind the cheap tests, wherever the optimizer moves it."""
    possible, decided = _cheap(a, b, k)
    distance = F.when(possible, F.when(decided.isNotNull(), decided).otherwise(osa(a, b)))
    return F.when(distance <= k, distance)


def within_arrow(pairs: DataFrame, a: str, b: str, k: str, word_a: str, word_b: str) -> DataFrame:
    """pairs with distance (<= k): byte strings a and b decide what they can in the JVM, the rest goes through the Arrow kernel as words."""
    possible, decided = _cheap(F.col(a), F.col(b), F.col(k))
    open_ = pairs.where(possible).withColumn("_decided", decided)
    ask = lambda word: F.when(F.col("_decided").isNull(), F.col(word))
    judged = open_.withColumn("_table", osa_arrow(ask(word_a), ask(word_b)))
    return judged.withColumn("distance", F.coalesce("_decided", "_table").cast("int")).where(F.col("distance") <= F.col(k)).drop("_decided", "_table")


def osa_python(a: bytes, b: bytes) -> int:
    before, last = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def table_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Distances of many pairs at once: the table's cells are vectors over the pairs."""
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    x, y = (np.zeros((n, max(1, int(m.max(initial=0)))), np.int16) - k for m, k in ((la, 1), (lb, 2)))
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x[i, : len(s)] = np.frombuffer(s, np.uint8)
        y[i, : len(t)] = np.frombuffer(t, np.uint8)
    width = y.shape[1] + 1
    out = lb.copy()
    before = last = np.broadcast_to(np.arange(width), (n, width)).copy()
    for i in range(1, x.shape[1] + 1):
        row = np.empty((n, width), np.int64)
        row[:, 0] = i
        for j in range(1, width):
            same = x[:, i - 1] == y[:, j - 1]
            best = np.minimum(np.minimum(last[:, j], row[:, j - 1]) + 1, last[:, j - 1] + ~same)
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swap, np.minimum(best, before[:, j - 2] + 1), best)
            row[:, j] = best
        before, last = last, row
        done = la == i
        out[done] = row[done, lb[done]]
    return out


#: Bytes of the shorter string that the bits of one word hold, and pairs that are worked on together.
WORD_BITS, TOGETHER = 64, 4096


def bit_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Distances of many pairs at once, bit-parallel: the shorter string of each pair, of WORD_BITS bytes at most, lies along the bits.

    Bits say where a column of the table rises (up) or falls (down) against the row above; each byte of the longer string
    moves all pairs one column on. A transposition starts where this byte stood one place on and the last byte here.
    """
    short = [min(x, y, key=len) for x, y in zip(a, b, strict=True)]
    long = [max(y, x, key=len) for x, y in zip(a, b, strict=True)]
    n, one = len(a), np.uint64(1)
    m, width = (np.fromiter(map(len, x), np.int64, n) for x in (short, long))
    x, y = (np.zeros((n, int(size.max(initial=0))), np.uint8) for size in (m, width))
    for i, (s, t) in enumerate(zip(short, long, strict=True)):
        x[i, : len(s)], y[i, : len(t)] = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
    rows = np.arange(n)
    masks = np.zeros((n, 256), np.uint64)
    for i in range(x.shape[1]):
        own = rows[m > i]
        masks[own, x[own, i]] |= one << np.uint64(i)
    last = np.maximum(m - 1, 0).astype(np.uint64)
    distance, up, down = m.copy(), np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    diagonal, before = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(y.shape[1]):
        same = masks[rows, y[:, j]]
        swapped = ((~diagonal & same) << one) & before
        diagonal = (((same & up) + up) ^ up) | same | down | swapped
        rise, fall = down | ~(diagonal | up), diagonal & up
        open_ = j < width
        distance += np.where(open_, (rise >> last & one).astype(np.int64) - (fall >> last & one).astype(np.int64), 0)
        rise, fall = rise << one | one, fall << one
        up, down, before = fall | ~(diagonal | rise), rise & diagonal, same
    return np.where(m == 0, width, distance)


def osa_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Distances of many pairs, each by the kernel that its lengths allow."""
    out = np.empty(len(a), np.int64)
    fits = np.fromiter((min(len(x), len(y)) <= WORD_BITS for x, y in zip(a, b, strict=True)), bool, len(a))
    for kernel, own in ((bit_pairs, np.flatnonzero(fits)), (table_pairs, np.flatnonzero(~fits))):
        for i in range(0, len(own), TOGETHER):
            part = own[i : i + TOGETHER]
            out[part] = kernel([a[k] for k in part], [b[k] for k in part])
    return out


@pandas_udf(IntegerType())
def osa_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """The distance of two words (not byte strings) by Arrow batches."""
    known = a.notna() & b.notna()
    out = pd.Series([None] * len(a), dtype="Int32")
    out[known.to_numpy()] = osa_pairs([s.encode() for s in a[known]], [s.encode() for s in b[known]])
    return out
