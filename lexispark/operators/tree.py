"""Statistics and drawing of the compressed prefix tree that an index of the dictionary amounts to.

No tree is built, and no prefix is written out that is not a node. Every prefix of a word (by bytes) is a node; a node
with one child that is no word joins its child, seven at most in a row, so along a word every eighth node of such a chain
stays. What never joins is a word, or a fork: what two neighbours among the sorted words have in common. So each range of
sorted words yields its forks in one pass with a stack, two for a word at most. Only those on the paths of a range's first
and last word may go on in other ranges: a few for each range, which one task adds up by their lengths.

Words may be long, so the driver is sent none: tasks draw a sample of them, one task picks where ranges begin, and the
driver gets those beginnings only, cut after the first byte that tells them from the word before and without what they
have in common.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.sources.dictionary import with_bytes
from lexispark.sources.workspace import new_path

#: Bytes of a node, by the number of children it has room for.
NODE_BYTES = {"node0": 16, "node4": 52, "node16": 160, "node48": 656, "node256": 2064}
#: Shapes of the drawing.
SHAPES = {"node0": "circle", "node4": "triangle", "node16": "box", "node48": "pentagon", "node256": "hexagon"}
CHAIN = 8
#: What a row of a range is: a node with all its children, or the range's ends: its first word (prefix) and its last, with the
#: nodes on their paths that other ranges may add to, as OPEN: [length, n_pairs, is a word, freq, below], shortest first. They
#: have lengths, not prefixes: a path of nested words has as many nodes as bytes.
WHOLE, ENDS = range(2)
RANGE_ROWS = "role int, prefix binary, above int, n_pairs long, is_word boolean, freq long, below int, last binary, on_first array<array<long>>, on_last array<array<long>>"
NODE_ROWS = "prefix binary, above int, n_children long, freq long"
#: Words that a task gives at least to the sample that ranges are cut by (if it has as many), and bytes of the sample, of as many
#: tasks as there are ranges. The sample decides how even ranges are, and nothing else.
SAMPLE_WORDS, SAMPLE_BYTES = 100, 8 << 20


def common_lengths(words: list[bytes]) -> np.ndarray:
    """Bytes that each word has in common with the one before; 0 for the first."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
    out = np.zeros(len(words), np.int64)
    most = np.minimum(sizes[:-1], sizes[1:])
    open_, n = np.flatnonzero(most), 0
    while len(open_):
        open_ = open_[data[starts[open_] + n] == data[starts[open_ + 1] + n]]
        n += 1
        out[open_ + 1] = n
        open_ = open_[most[open_] > n]
    return out


def stay(length: int, above: int) -> int:
    """Nodes that stay between a fork or word and the next such node above it (-1: none), itself included."""
    return 1 + (length - above - 1) // CHAIN


def range_rows(batches: Iterable[tuple[list[bytes], list[int]]]) -> Iterator[tuple]:
    """RANGE_ROWS of sorted words that differ, with their frequencies.

    On the stack is the path of the word before: [length, lies on the first word's path, pairs of neighbours that part
    here, is a word, freq, most nodes that stay below it]. A node is done once a word comes that lacks its prefix.
    """
    stack: list[list] = []
    on_first: list[list] = []
    start = before = None
    for words, freqs in batches:
        for word, freq, n in zip(words, freqs, common_lengths([before or b"", *words])[1:].tolist(), strict=True):
            if before is None:
                stack.append([len(word), True, 0, True, freq, 0])
                start = before = word
                continue
            if word == before:
                continue
            first, deep = False, 0
            while stack and stack[-1][0] > n:
                length, first, n_pairs, is_word, own, below = stack.pop()
                above = max(n, stack[-1][0]) if stack else n
                if first:
                    on_first.append([length, n_pairs, int(is_word), own, below])
                else:
                    yield (WHOLE, before[:length], above, n_pairs, is_word, own, below, None, None, None)
                deep = 0 if first else below + stay(length, above)
                if stack and stack[-1][0] == above:
                    stack[-1][5] = max(stack[-1][5], deep)
            if stack and stack[-1][0] == n:
                stack[-1][2] += 1
            else:
                stack.append([n, first, 1, False, None, deep])
            stack.append([len(word), False, 0, True, freq, 0])
            before = word
    if before is not None:
        yield (ENDS, start, None, None, None, None, None, before, on_first[::-1], [[x[0], x[2], int(x[3]), *x[4:]] for x in stack])


def merge(path: list[list], more: list[list]) -> None:
    """Add OPEN nodes to those of a path, both shortest first, each length once."""
    cut = bisect_left(path, more[0][0], key=lambda node: node[0]) if more else len(path)
    found = {node[0]: node for node in path[cut:]}
    for length, n_pairs, is_word, freq, below in more:
        node = found.setdefault(length, [length, 0, 0, None, 0])
        node[1] += n_pairs
        if is_word:
            node[2:4] = 1, freq
        node[4] = max(node[4], below)
    path[cut:] = [found[length] for length in sorted(found)]


def open_nodes(rows: Iterable[tuple]) -> tuple[list[tuple[bytes, list[list]]], int]:
    """(word, [[length, above, n_children, freq], ...]) of the nodes on the paths of all ranges' ends, and the most nodes below the root on a path. Ranges follow on each other, so do their ends: a stack goes along them as in range_rows."""
    out: list[tuple[bytes, list[list]]] = []
    path: list[list] = []
    deep, before = 0, None

    def leave(word: bytes, n: int) -> int:
        """Take off the path of word what is longer than n; the most nodes that stay below n there."""
        done, deep = [], 0
        while path and path[-1][0] > n:
            length, n_pairs, is_word, freq, below = path.pop()
            above = max(n, path[-1][0]) if path else n
            done.append([length, above, n_pairs + (not is_word), freq])
            deep = below + stay(length, above)
            if path and path[-1][0] == above:
                path[-1][4] = max(path[-1][4], deep)
        out.append((word, done))
        return deep

    for _, start, *_, last, on_first, on_last in sorted(rows, key=lambda row: row[1]):
        if before is not None:
            n = int(common_lengths([before, start])[1])
            deep = leave(before, n)
            merge(path, [[n, 1, 0, None, deep if not path or path[-1][0] < n else 0]])
        n = int(common_lengths([start, last])[1])
        merge(path, [*(x for x in on_last if x[0] <= n), *on_first])
        leave(start, n)
        merge(path, [x for x in on_last if x[0] > n])
        before = last
    if before is not None:
        deep = leave(before, -1)
    return [x for x in out if x[1]], max(0, deep - 1)


def joined(rows: Iterable[tuple]) -> tuple[list[tuple], int]:
    """open_nodes with their prefixes: (prefix, above, n_children, freq), as forks has executors write them out."""
    found, height = open_nodes(rows)
    return [(word[:length], *node) for word, nodes in found for length, *node in nodes], height


def drawn(batches: Iterable[list[bytes]], most: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """(word, weight) of up to twice as many words as given, and no more bytes; longer words are cut. Weights stand for bytes of all words, and some for each word itself."""
    rng, share = random.Random(0), 1.0
    kept: list[tuple[bytes, int]] = []
    size = 0
    for words in batches:
        for word in words:
            if share < 1 and rng.random() >= share:
                continue
            kept.append((word[:most_bytes], len(word) + 50))
            size += len(kept[-1][0])
            while len(kept) > 2 * most or size > most_bytes:
                kept, share = [x for x in kept if rng.random() < 0.5], share / 2
                size = sum(len(word) for word, _ in kept)
    return [(word, int(weight / share)) for word, weight in kept]


def beginnings(sample: Iterable[tuple[bytes, int]], parts: int) -> list[tuple[int, bytes]]:
    """Where up to parts ranges of words begin, the first aside: (bytes in common with the beginning before, the other bytes), in order."""
    words: dict[bytes, int] = {}
    for word, weight in sample:
        words[word] = words.get(word, 0) + weight
    srt = sorted(words)
    same = common_lengths(srt).tolist()
    sums = [0, *accumulate(words[word] for word in srt)]
    out, before = [], b""
    for i in range(1, len(srt)):
        if sums[i] * parts // sums[-1] > sums[i - 1] * parts // sums[-1]:
            at = srt[i][: same[i] + 1]
            n = int(common_lengths([before, at])[1])
            out.append((n, at[n:]))
            before = at
    return out


def whole_beginnings(cut: Iterable[tuple[int, bytes]]) -> list[bytes]:
    return list(accumulate(cut, lambda before, x: before[: x[0]] + x[1], initial=b""))[1:]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _batches(rows: Iterable[tuple], ddl: str, binary: int = 0) -> Iterator[pa.RecordBatch]:
    """rows in batches that are bounded in rows and in bytes of the column given."""
    schema = _arrow(ddl)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[binary] or b"")
        if len(held) >= 20_000 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def ranges(own: DataFrame, parts: int) -> DataFrame:
    """own (prefix, freq) in up to parts ranges by prefix, one to a partition, each sorted. Prefixes are read once to draw a sample, and again."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(drawn((b.column(0).to_pylist() for b in batches), SAMPLE_WORDS, SAMPLE_BYTES // parts), "word binary, weight long")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((i, n, rest) for i, (n, rest) in enumerate(beginnings(_tuples(batches), parts))), "place int, same int, rest binary", 2)

    sample = own.select("prefix").mapInArrow(draw, "word binary, weight long").repartition(1)
    cut = [(x.same, bytes(x.rest)) for x in sorted(sample.mapInArrow(pick, "place int, same int, rest binary").collect(), key=lambda x: x.place)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = whole_beginnings(cut)
        for b in batches:
            yield b.append_column("part", pa.array([bisect_right(begin, word) for word in b.column(0).to_pylist()], pa.int32()))

    return own.mapInArrow(deal, "prefix binary, freq long, part int").repartitionById(parts, F.col("part")).sortWithinPartitions("prefix").select("prefix", "freq")


def forks(words: DataFrame) -> tuple[DataFrame, int]:
    """(prefix, pos, above, n_children, freq) of all words and forks, with the length of the next such prefix above (-1: none), and the tree's height. Work is done at once, into tables in the shared folder."""
    d = words if "wb" in words.columns else with_bytes(words)
    spark = words.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(range_rows((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches), RANGE_ROWS, 1)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The open nodes, and the height as a row without a prefix."""
        found, height = open_nodes(_tuples(batches))
        yield from _batches(((word[:length], *node) for word, nodes in found for length, *node in nodes), NODE_ROWS)
        yield from _batches([(None, height, None, None)], NODE_ROWS)

    own = d.where("wb is not null").select(F.encode("wb", "ISO-8859-1").alias("prefix"), F.col("freq").cast("long").alias("freq"))
    path, open_path = new_path(spark, "tree"), new_path(spark, "tree-open")
    ranges(own, parts).mapInArrow(run, RANGE_ROWS).write.parquet(path)
    rows = spark.read.schema(RANGE_ROWS).parquet(path)
    rows.where(F.col("role") == ENDS).repartition(1).mapInArrow(join, NODE_ROWS).write.parquet(open_path)  # one row for each range
    shared = spark.read.schema(NODE_ROWS).parquet(open_path)
    height = shared.where("prefix is null").agg(F.coalesce(F.max("above"), F.lit(0)).alias("height")).collect()[0].height
    whole = rows.where(F.col("role") == WHOLE).select("prefix", "above", (F.col("n_pairs") + (~F.col("is_word")).cast("long")).alias("n_children"), "freq")
    out = whole.unionByName(shared.where("prefix is not null"))
    return out.select(F.decode("prefix", "ISO-8859-1").alias("prefix"), F.length("prefix").alias("pos"), "above", "n_children", "freq"), height


def _places(found: DataFrame) -> DataFrame:
    """found, a row for each node that stays, with its length (place) and its parent's (-1 for the root, the shortest of all)."""
    chain = F.when(F.col("above") + CHAIN < F.col("pos"), F.sequence(F.col("above") + CHAIN, F.col("pos") - 1, F.lit(CHAIN))).otherwise(F.array().cast("array<int>"))
    each = found.withColumn("place", F.explode(F.concat(chain, F.array("pos"))))
    up = F.when(F.col("place") < F.col("pos"), F.col("place") - CHAIN).otherwise(F.col("pos") - 1 - F.pmod(F.col("pos") - F.col("above") - 1, F.lit(CHAIN)))
    return each.withColumn("up", up)


def kind(n_children, is_root):
    return F.when(is_root | (n_children > 48), "node256").when(n_children > 16, "node48").when(n_children > 4, "node16").when(n_children > 0, "node4").otherwise("node0")


def _nodes(found: DataFrame) -> DataFrame:
    whole = F.col("place") == F.col("pos")
    rows = _places(found).select(F.substr(F.col("prefix"), F.lit(1), F.col("place")).alias("prefix"), F.when(whole, F.col("n_children")).otherwise(1).alias("n_children"), F.when(whole, F.col("freq")).alias("freq"), (F.col("up") < 0).alias("is_root"))
    return rows.withColumn("kind", kind(F.col("n_children"), F.col("is_root")))


def _edges(found: DataFrame) -> DataFrame:
    cut = lambda start, n: F.substr(F.col("prefix"), start, n)
    return _places(found).where("up >= 0").select(cut(F.lit(1), F.col("up")).alias("parent"), cut(F.lit(1), F.col("place")).alias("child"), cut(F.col("up") + 1, F.col("place") - F.col("up")).alias("label"))


def tree_nodes(words: DataFrame) -> DataFrame:
    """(prefix, n_children, freq, is_root, kind) of the nodes that stay. The root is the shortest of them and has room for all children."""
    return _nodes(forks(words)[0])


def tree_edges(words: DataFrame) -> DataFrame:
    """(parent, child, label): the label is the key byte and the bytes joined into the child."""
    return _edges(forks(words)[0])


def information(words: DataFrame) -> DataFrame:
    """words, nodes, height, max_length (one more than the longest word, as an index counts its root) and longest_word."""
    d = words if "wb" in words.columns else with_bytes(words)
    own = d.agg(F.count("*").alias("words"), F.coalesce(F.max("len"), F.lit(0)).cast("long").alias("longest_word")).withColumn("max_length", F.col("longest_word") + 1)
    found, height = forks(d)
    stays = 1 + F.floor((F.col("pos") - F.col("above") - 1) / CHAIN)
    shape = found.agg(F.greatest(F.lit(1), F.coalesce(F.sum(stays), F.lit(0))).cast("long").alias("nodes")).withColumn("height", F.lit(max(1, height)).cast("long"))
    return own.crossJoin(F.broadcast(shape)).select("words", "nodes", "height", "max_length", "longest_word")  # one row each


def node_kinds(words: DataFrame) -> DataFrame:
    return tree_nodes(words).groupBy("kind").agg(F.count("*").alias("n"))


def index_bytes(words: DataFrame) -> DataFrame:
    """Bytes that the nodes would take."""
    size = F.create_map(*[F.lit(x) for pair in NODE_BYTES.items() for x in pair])
    return tree_nodes(words).agg(F.coalesce(F.sum(size[F.col("kind")]), F.lit(NODE_BYTES["node256"])).cast("long").alias("bytes"))


def node_id(prefix):
    """A stable name: the bytes of the prefix in hexadecimal."""
    return F.concat(F.lit("n"), F.lower(F.hex(F.encode(prefix, "ISO-8859-1"))))


def dot_lines(words: DataFrame) -> DataFrame:
    """(line_group, line) of the drawing's body: nodes, then edges. Words are green; byte labels print as Latin-1."""
    shape = F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])
    found = forks(words)[0]
    n = _nodes(found).select(F.lit(1).alias("line_group"), F.concat(node_id(F.col("prefix")), F.lit(' [label="'), F.coalesce(F.col("freq").cast("string"), F.lit("")), F.lit('", shape='), shape[F.col("kind")], F.when(F.col("freq").isNotNull(), F.lit(", color=green, style=filled")).otherwise(""), F.lit("];")).alias("line"))
    e = _edges(found).select(F.lit(2).alias("line_group"), F.concat(node_id(F.col("parent")), F.lit(" -> "), node_id(F.col("child")), F.lit(' [label="'), F.col("label"), F.lit('"];')).alias("line"))
    return n.unionByName(e)


def write_dot(words: DataFrame, path: str) -> None:
    spark = words.sparkSession
    frame = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "line_group int, line string")
    dot_lines(words).unionByName(frame).orderBy("line_group", "line").select("line").write.mode("overwrite").text(path)
