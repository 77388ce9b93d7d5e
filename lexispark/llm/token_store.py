"""Token ids in patched frame-of-reference files.

Documents are put in ascending order of their ids, encoded with a public tokenizer, closed with an end id, and written
as segments. A segment is a self-contained file image (`encode_segment` / `decode_segment`): blocks of 128 ids, each
less its minimum and packed at the width that covers 90 % of its values; larger values go to exception lists; the index
holds every block's start, so that any block can be read on its own (`read_block`). Segments are the binary column of a
Parquet dataset, so Spark's committers write them to any store and a lost task is simply written again.

Positions: a segment knows the tokens before it from two sums, over the segments of its shard (a window per shard) and
over the shards before it (one number per shard and range partition, which is all that reaches the driver).

Defined results: null text counts as empty and has the end id only; rows without an id come first; rows with equal ids
follow each other by their text; bytes that are no UTF-8 are replaced by U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm import common

BLOCK = 128
MAGIC, VERSION = b"PFOR", 1
PERCENTILE = 0.9
#: Ids of a segment, about.
SEGMENT_IDS = 1 << 20
#: Pieces and words of a generation of a worker's caches.
CACHE_PIECES, CACHE_WORDS = 260_000, 260_000


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values of `width` bits to rows of 2 * width 64-bit words."""
    out = np.zeros((2 * width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack_bits."""
    rows = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[0]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        value = rows[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= rows[word + 1] << np.uint64(64 - shift)
        out[j] = (value & mask).astype(np.uint32)
    return out.T


def encode_ids(ids: np.ndarray) -> bytes:
    """Blocks of ids: counts, index (block starts, minima, widths, numbers of exceptions), packed words, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[n - 1]
    table = padded.reshape(blocks, BLOCK)
    least = table.min(1) if blocks else np.zeros(0, np.uint32)
    rest = table - least[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bit_length(np.partition(rest, rank, 1)[:, rank]) if blocks else np.zeros(0, np.int64)
    above = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    of, place = np.nonzero(above)
    values = rest[of, place]
    packed = np.where(above, np.uint32(0), rest)
    starts = np.concatenate([[0], np.cumsum(2 * width)]).astype(np.int64)
    words = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            words[(starts[own][:, None] + np.arange(2 * w)).ravel()] = pack_bits(packed[own], w).ravel()
    head = struct.pack("<QQQQ", n, blocks, len(words), len(of))
    return b"".join([head, starts[:-1].astype("<u8").tobytes(), least.astype("<u4").tobytes(), width.astype("<u1").tobytes(), above.sum(1).astype("<u1").tobytes(), words.astype("<u8").tobytes(), place.astype("<u1").tobytes(), values.astype("<u4").tobytes()])


def _parts(data: bytes) -> tuple:
    n, blocks, n_words, n_more = struct.unpack_from("<QQQQ", data)
    at, out = 32, []
    for kind, count in (("<u8", blocks), ("<u4", blocks), ("<u1", blocks), ("<u1", blocks), ("<u8", n_words), ("<u1", n_more), ("<u4", n_more)):
        out.append(np.frombuffer(data, kind, count, at))
        at += int(kind[2]) * count
    return n, blocks, *out


def decode_ids(data: bytes) -> np.ndarray:
    n, blocks, starts, least, width, more, words, place, values = _parts(data)
    table = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            table[own] = unpack_bits(words[starts[own].astype(np.int64)[:, None] + np.arange(2 * w)], w)
    of = np.repeat(np.arange(blocks), more)
    table[of, place] = values
    return (table + least[:, None]).ravel()[:n]


def read_block(data: bytes, block: int) -> np.ndarray:
    """Ids of one block: its start comes from the index, nothing else is unpacked."""
    n, blocks, starts, least, width, more, words, place, values = _parts(data)
    w, at = int(width[block]), int(starts[block])
    row = unpack_bits(words[at : at + 2 * w].reshape(1, -1), w)[0].copy()
    before, own = int(more[:block].sum(dtype=np.int64)), int(more[block])
    row[place[before : before + own]] = values[before : before + own]
    return (row + least[block])[: n - block * BLOCK]


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    plain = np.array([d or 0 for d in doc_ids], "<i8")
    body = b"".join([struct.pack("<Q", len(doc_ids)), plain.tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), encode_ids(ids)])
    return MAGIC + struct.pack("<II", VERSION, zlib.crc32(body)) + body


def decode_segment(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    version, crc = struct.unpack_from("<II", data, 4)
    body = memoryview(data)[12:]
    if data[:4] != MAGIC or version != VERSION or zlib.crc32(body) != crc:
        raise ValueError("not a segment, or a damaged one")
    (n,) = struct.unpack_from("<Q", body)
    plain, known = np.frombuffer(body, "<i8", n, 8), np.frombuffer(body, "<u1", n, 8 + 8 * n)
    counts = np.frombuffer(body, "<u4", n, 8 + 9 * n)
    return decode_ids(body[8 + 13 * n :]), [d if k else None for d, k in zip(plain.tolist(), known.tolist(), strict=True)], counts


#: Texts that the tokenizer's normalisation leaves alone but for lower case of the same length: printable ASCII and the Latin letters below.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-įı-ž]+")


@lru_cache(1)
def part_kinds() -> np.ndarray:
    """Kinds of signs of plain pieces in lower case: 0 blank, 1 letter, 2 digit, 3 other. Runs of letters and of others, and each digit, are a word to the tokenizer."""
    kinds = np.full(0x180, 3, np.uint8)
    kinds[[*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x180)]] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[0x20] = 0
    return kinds


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    more = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(more)) for b in range(256)]


def folded(raw: bytes) -> bytes:
    """raw (UTF-8) with A-Z in lower case where that changes nothing for a tokenizer that composes first and lower-cases then: nothing is left to compose. (Of capitals that compose only as such there is I with a dot, whose lower case comes apart again.)"""
    low = raw.lower()
    return low if raw.isascii() or unicodedata.is_normalized("NFC", low.decode()) else raw


class Words:
    """The tokenizer with a cache of pieces between blanks. No token of this vocabulary crosses a blank or line feed, so pieces are encoded one by one.

    New pieces of plain Latin text are cut into words and signs here, as the tokenizer would, and only new words reach its
    model. Any other piece goes through the whole tokenizer, and so does, uncut, a text that holds a special token.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.marks = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache, self.words = common.Cache(CACHE_PIECES), common.Cache(CACHE_WORDS)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [got.ids for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces end to end, and the number of ids of each."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = (" ".join(pieces) + " ").lower()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = part_kinds()[codes]
        begins = (kind > 0) & ((kind != np.concatenate([[0], kind[:-1]])) | (kind == 2))
        starts, edges = np.flatnonzero(begins), np.flatnonzero(begins | (kind == 0))
        stops = edges[np.searchsorted(edges, starts, side="right")]
        make = lambda new: common.end_to_end([self._word(text[i:j]) for i, j in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
        ids, counts = self.words.take(common.slice_hashes(codes, starts, stops - starts), make)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.cumsum(begins)[kind == 0]], prepend=0)

    def _word(self, word: str) -> list[int]:
        """Ids of one word in lower case, by the library's model."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else "".join([self.letters[b] for b in word.encode()]))]

    def _make(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        if plain.all():
            return self._plain(pieces)
        first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        made = [self._plain([pieces[i] for i in first.tolist()]), common.end_to_end(self._library([pieces[i] for i in rest.tolist()]))]
        counts = np.zeros(len(pieces), np.int64)
        begins = np.zeros(len(pieces), np.int64)
        before = 0
        for where, (ids, own) in zip((first, rest), made, strict=True):
            counts[where] = own
            begins[where] = before + np.cumsum(own) - own
            before += len(ids)
        return common.spread(np.concatenate([ids for ids, _ in made]), begins, counts), counts

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the number of ids of each."""
        raw = [x or b"" for x in texts]
        joined = b"\n".join(raw) + b"\n"
        try:
            whole = folded(joined)
        except UnicodeDecodeError:
            raw = [x.decode("utf-8", "replace").encode() for x in raw]
            joined = b"\n".join(raw) + b"\n"
            whole = folded(joined)
        if whole is joined and whole != joined.lower():
            whole = b"\n".join([folded(x) for x in raw]) + b"\n"
        special = [i for i, x in enumerate(raw) if any(m in x for m in self.marks)] if any(m in joined for m in self.marks) else []
        data = np.frombuffer(whole, np.uint8)
        stops = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], stops[:-1] + 1])
        some = stops > starts
        starts, stops = starts[some], stops[some]
        make = lambda new: self._make([whole[i:j].decode() for i, j in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
        ids, counts = self.cache.take(common.slice_hashes(data, starts, stops - starts), make)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))) - 1
        totals = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, ends)]
        if special:
            parts = np.split(ids, totals[:-1])
            for i, own in zip(special, self._library([raw[i].decode() for i in special]), strict=True):
                parts[i] = np.array(own, np.uint32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.diff(totals, prepend=0)


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write segments of docs to path: (shard, segment, n_docs, n_tokens, data)."""
    spark = common.tune(docs.sparkSession)
    parts = common.bucket_count(common.input_bytes(docs), 8 << 20, least=8)
    source = docs.select(common.quoted(doc_id).cast("long").alias("doc_id"), common.binary(text).alias("text"))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, segment = words_of(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, docs_, counts = np.concatenate([h[0] for h in held]), [d for h in held for d in h[1]], np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": pa.array([len(docs_)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "data": pa.array([encode_segment(ids, docs_, counts)], pa.binary())})

        for table in common.chunks(batches):
            ids, counts = words.encode(table.column("text").to_pylist())
            ids, counts = with_end(ids, counts, end_id)
            held.append((ids, table.column("doc_id").to_pylist(), counts))
            if sum(len(h[0]) for h in held) >= SEGMENT_IDS:
                yield flush()
                held, segment = [], segment + 1
        if held:
            yield flush()

    ordered.mapInArrow(run, "shard int, segment int, n_docs long, n_tokens long, data binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, token_ids]) of every document in the segments of path, in any order."""
    common.tune(spark)
    files = spark.read.schema("shard int, segment int, n_docs long, n_tokens long, data binary").parquet(path)
    heads = files.select("shard", "segment", "n_tokens")
    total, before = 0, []
    for shard, n in sorted(heads.groupBy("shard").agg(F.sum("n_tokens")).collect()):  # a number for each range partition
        before.append((shard, total))
        total += n
    shards = spark.createDataFrame(before, "shard int, before long")
    order = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = heads.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(F.broadcast(shards), "shard").select(F.col("shard").alias("s"), F.col("segment").alias("g"), (F.col("before") + F.col("inside")).alias("first"))
    placed = files.join(common.sized(first), (F.col("shard") == F.col("s")) & (F.col("segment") == F.col("g"))).select("first", "data")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_id, data in zip(batch.column("first").to_pylist(), batch.column("data"), strict=True):
                ids, doc_ids, counts = decode_segment(data.as_buffer().to_pybytes())
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + first_id, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: write all documents' ids, read the files back and report each document's place, length and checksum."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = common.new_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, with_ids=False)
