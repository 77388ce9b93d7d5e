"""What the training-data operators share: shared tables, sized joins, packed shuffles and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on. Memory of a Python worker is a small multiple of it.
CHUNK_BYTES = 2 << 20
#: Bytes of groups after which a worker of a grouped function gives freed memory back.
RELAX_BYTES = 32 << 20
#: Rows up to which a small side is broadcast after being counted; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 24 << 20

U64 = np.uint64
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def fmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where none is set, a local one if all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_lexispark_dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            found = "file://" + tempfile.mkdtemp(prefix="lexispark-")
            spark.sparkContext._lexispark_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexispark/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs no more than the read."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, default: int = 64 << 20) -> int:
    """Bytes that Catalyst's statistics give for df: the files' size for a scan. Used for numbers of buckets only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if 0 < size < 1 << 60 else default


def bucket_count(size: int, per_bucket: int, least: int = 64, most: int = 1 << 20) -> int:
    return int(min(most, max(least, size // per_bucket)))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """schema with the fields of ddl at its end."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(ddl).fields])


def sized(small: DataFrame, rows: int = BROADCAST_ROWS, blob: str | None = None, blob_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """small, marked for broadcast if it has at most so many rows and bytes in its binary column (both are measured); otherwise as it is, for a shuffled join."""
    if blob is None:
        return F.broadcast(small) if small.count() <= rows else small
    n, size = small.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(blob)), F.lit(0))).first()
    return F.broadcast(small) if n <= rows and size <= blob_bytes else small


def tune(spark: SparkSession) -> SparkSession:
    """Batches of a few hundred rows keep long texts from piling up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def quoted(column: str):
    """The column of that name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it a name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def binary(column: str = "text"):
    """Text as UTF-8 bytes: a worker then decides on its own what to do with bytes that are no UTF-8."""
    return quoted(column).cast("binary").alias(column)


def relax() -> None:
    """Give memory that an earlier task in this worker has freed back to the system: workers are used again, and several share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


_grouped = 0


def eased(group: pa.Table) -> pa.Table:
    """The group of a grouped function; each RELAX_BYTES of groups, what earlier ones have freed is given back first."""
    global _grouped
    _grouped += group.nbytes
    if _grouped > RELAX_BYTES:
        _grouped = 0
        relax()
    return group


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup batches so that each holds about `limit` bytes of `column` (a longer single row stays whole)."""
    relax()
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
        start = 0
        ends = np.cumsum(sizes)
        base = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, base + max(0, limit - total), side="right"))
            stop = max(stop, start + (not held))
            stop = min(stop, batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                total += int(ends[stop - 1]) - base
                base, start = int(ends[stop - 1]), stop
            if start < batch.num_rows or total >= limit:
                if held:
                    yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def added_columns(df: DataFrame, text: str, ddl: str, start: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]], keep_text: bool = True) -> DataFrame:
    """df with the columns of ddl, which start()(texts of a chunk) makes; columns of these names are replaced.

    start runs once in each task. The text goes to the workers once, as bytes, and comes back only if it is kept. Columns
    are numbered on the way, so names of any kind will do. A map over rows: nothing is shuffled.
    """
    fields = T._parse_datatype_string(ddl).fields
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    if text not in kept:
        raise ValueError(f"the column {text} would be replaced")
    source = df.select(*[(quoted(c).cast("binary") if c == text else quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)])
    body = f"c{kept.index(text)}"
    schema = T.StructType([*(f for f in source.schema.fields if keep_text or f.name != body), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for chunk in chunks(batches, body):
            out = chunk if keep_text else chunk.drop_columns([body])
            for field, column in zip(fields, make(chunk.column(body).to_pylist()), strict=True):
                out = out.append_column(field.name, column)
            yield from out.to_batches()

    back = [(F.col(f"c{i}").cast("string") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(kept) if keep_text or c != text]
    return source.mapInArrow(run, schema).select(*back, *(f.name for f in fields))


def decoded(texts: list[bytes | None]) -> list[str]:
    """Texts of a chunk; null counts as empty, bytes that are no UTF-8 become U+FFFD."""
    return [(x or b"").decode("utf-8", "replace") for x in texts]


def int64s(column: pa.ChunkedArray) -> np.ndarray:
    """A column of longs without nulls."""
    return column.cast(pa.int64()).to_numpy()


def split_words(texts: list[bytes | None], fold: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, one after the other, and the number of words of each. bytes.split() and bytes.lower() know ASCII only, which is what is asked for."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.lower().split() if fold else text.split()
            counts[i] = len(own)
            words += own
    return words, counts


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))


def poly(values: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of each run of `length` consecutive values, by doubling; the last length-1 places hold partial runs."""
    out, have, power = np.zeros_like(values), 0, pow(base, 0)
    part, size = values, 1
    mask = (1 << 64) - 1
    while size <= length:
        if length & size:
            moved = part if not have else np.concatenate([part[have:], np.zeros(min(have, len(part)), U64)])[: len(values)]
            out = out + moved * U64(pow(base, have, 1 << 64))
            have += size
        size *= 2
        if size <= length:
            half = size // 2
            part = part + np.concatenate([part[half:], np.zeros(min(half, len(part)), U64)])[: len(values)] * U64(pow(base, half, 1 << 64) & mask)
    return fmix(out)


def within(counts: np.ndarray, length: int) -> np.ndarray:
    """True where a run of `length` places that starts here ends inside the same document."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + length <= ends


def packed(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Entries by bucket: (bucket, columns' entries) for each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1)) if n_buckets < 1 << 14 else None
    if edges is None:
        found, first = np.unique(bucket[order], return_index=True)
        edges_list = list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True))
    else:
        edges_list = [(b, int(edges[b]), int(edges[b + 1])) for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
    columns = [x[order] for x in columns]
    for b, i, j in edges_list:
        yield b, [x[i:j] for x in columns]


def gather(blobs: Iterable[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] for all i, end to end."""
    total = int(counts.sum())
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)]


BLOCK_SPAN = 1 << 20
PIECE_BASE = 0xD1342543DE82EF95


@lru_cache(1)
def _piece_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to BLOCK_SPAN - 1 of the base of slices' hashes and of its inverse, modulo 2^64."""
    bases = PIECE_BASE, pow(PIECE_BASE, -1, 1 << 64)
    up, down = (np.cumprod(np.concatenate([[U64(1)], np.full(BLOCK_SPAN - 1, b, U64)]), dtype=U64) for b in bases)
    return up, down


def slice_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice values[start : start + length] of small whole numbers; starts ascend. No string is made of any slice."""
    up, down = _piece_powers()
    out = np.empty(len(starts), U64)
    ends = starts + lengths
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK_SPAN, side="right"))
        if j <= i:  # a slice longer than a block
            part = np.ascontiguousarray(values[base : int(ends[i])], np.uint32)
            out[i] = xxhash.xxh64_intdigest(part.tobytes())
            i += 1
            continue
        part = values[base : int(ends[j - 1])].astype(U64)
        part += U64(1)
        part *= up[: len(part)]
        total = np.empty(len(part) + 1, U64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        at = starts[i:j] - base
        out[i:j] = fmix((total[ends[i:j] - base] - total[at]) * down[at] + lengths[i:j].astype(U64) * M1)
        i = j
    return out


class Keys:
    """Numbers 0, 1, ... for 64-bit hashes: an open table that whole arrays of hashes are looked up in."""

    def __init__(self, bits: int = 15):
        self.count = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.hashes, self.numbers = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that have none."""
        out = np.full(len(hashes), -1, np.int64)
        mask = (1 << self.bits) - 1
        slot = (hashes >> U64(64 - self.bits)).astype(np.int64)
        number = self.numbers[slot]
        hit = self.hashes[slot] == hashes
        hit &= number >= 0
        out[hit] = number[hit]
        open_ = np.flatnonzero((number >= 0) & ~hit)
        slot = slot[open_]
        while len(open_):
            slot = slot + 1 & mask
            number = self.numbers[slot]
            hit = (self.hashes[slot] == hashes[open_]) & (number >= 0)
            out[open_[hit]] = number[hit]
            go = (number >= 0) & ~hit
            open_, slot = open_[go], slot[go]
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (hashes >> U64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[free]
            self.hashes[slot[free]] = hashes[free]
            left = self.numbers[slot] != numbers
            hashes, numbers, slot = hashes[left], numbers[left], slot[left] + 1 & mask

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash, and for each new number, in order, a place where its hash stands."""
        at = self.find(hashes)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at, missing
        new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
        numbers = np.arange(self.count, self.count + len(new), dtype=np.int32)
        at[missing] = numbers[inverse]
        if 2 * (self.count + len(new)) > 1 << self.bits:
            some = self.numbers >= 0
            old = self.hashes[some], self.numbers[some]
            self._make(int(2 * (self.count + len(new)) - 1).bit_length())
            self._insert(*old)
        self._insert(new, numbers)
        self.count += len(new)
        return at, missing[first]


class Cache:
    """Lists of numbers (or rows of `width` numbers) by hash, end to end in one array.

    Beyond `most` entries a new generation begins; entries of the one before that are met again move over, so frequent
    ones are never made twice.
    """

    def __init__(self, most: int, dtype=np.uint32, width: int = 0):
        self.most, self.dtype, self.width = most, dtype, width
        self.old: Cache | None = None
        self.keys = Keys()
        self.values = np.zeros((1 << 10, width) if width else 1 << 12, dtype)
        self.starts, self.lengths = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.used = 0

    def _room(self, name: str, size: int) -> None:
        have = getattr(self, name)
        if len(have) < size:
            setattr(self, name, np.concatenate([have, np.zeros((max(size, 2 * len(have)) - len(have), *have.shape[1:]), have.dtype)]))

    def _append(self, numbers: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        self._room("values", self.used + len(values))
        self.values[self.used : self.used + len(values)] = values
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(values)

    def numbers(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The entry of each hash. make(places in hashes) gives (lists end to end, their lengths) of those that are in neither generation."""
        if self.keys.count > self.most:
            kept = Cache.__new__(Cache)
            kept.__dict__ = self.__dict__ | {"old": None}
            self.__init__(self.most, self.dtype, self.width)
            self.old = kept
        had = self.keys.count
        at, new = self.keys.number(hashes)
        if len(new):
            numbers = np.arange(had, had + len(new))
            self._room("starts", had + len(new))
            self._room("lengths", had + len(new))
            ask = np.ones(len(new), bool)
            if self.old is not None:
                before = self.old.keys.find(hashes[new])
                ask = before < 0
                before = before[~ask]
                lengths = self.old.lengths[before].astype(np.int64)
                self._append(numbers[~ask], spread(self.old.values, self.old.starts[before], lengths), lengths)
            if ask.any():
                try:
                    made = make(new[ask])
                except BaseException:  # a task that fails must not leave numbers without lists to the worker's next one
                    self.__init__(self.most, self.dtype, self.width)
                    raise
                self._append(numbers[ask], *made)
        return at

    def take(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Lists of all hashes end to end, and the length of each."""
        at = self.numbers(hashes, make)
        counts = self.lengths[at].astype(np.int64)
        return spread(self.values, self.starts[at], counts), counts


def end_to_end(lists: list[list[int]], dtype=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """What a cache takes: all lists in one array, and their lengths."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype, int(counts.sum())), counts


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(texts, each with a line feed after it; their code points; places of those line feeds)."""
    joined = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends


LETTER, MARK = 1, 2


@lru_cache(1)
def letter_table() -> np.ndarray:
    """LETTER or MARK for code points of these general categories, else 0."""
    kinds = {"L": LETTER, "M": MARK}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def letter_runs(texts: list[str], marks: bool = False) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts, starts, lengths, hashes, numbers by text) of all runs of letters; with marks, a run goes on over combining marks after its first letter."""
    joined, codes, ends = code_points(texts)
    kind = letter_table()[codes]
    inside = kind > 0 if marks else kind == LETTER
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    if marks and len(starts):
        odd = np.flatnonzero(kind[starts] == MARK)
        if len(odd):
            letters = np.flatnonzero(kind == LETTER)
            starts = starts.copy()
            starts[odd] = np.append(letters, len(codes))[np.searchsorted(letters, starts[odd])]
            some = starts < stops
            starts, stops = starts[some], stops[some]
    lengths = stops - starts
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return joined, starts, lengths, slice_hashes(codes, starts, lengths), counts
