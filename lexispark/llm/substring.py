"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 31 twenty-word grams in each window of 50 words, the one of least hash (leftmost
among equals) is the window's anchor, so documents that share a window share its anchor. Documents are joined on
anchors; anchors of one document only go no further. Around each shared anchor the match is extended both ways, as far
as windows that rest on this anchor reach (30 words to either side), one window at a time: a window's hash meets equal
windows of all other documents, and the least document among them keeps it. Windows that follow each other unite to
maximal repeats, which are cut out.

A word goes if a window of 50 consecutive words covers it whose words also start in a document of smaller id. All
windows are judged on the input.

Scale: entries travel packed, one row per batch and bucket. Of equal anchors or windows of a batch one entry is sent (of
the batch's least document; its other documents already know of a smaller one), so a passage that a third of all
documents hold costs one entry per batch. The text is read in place; only lists of shared anchors and cut windows meet it.

Defined results: null and empty texts have no words; texts under 50 words lose nothing; rows with equal ids count as one
document, whose windows are no repeats of each other; rows without an id are left as they are and make nothing go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.common import U64

WINDOW = 50
GRAM = 20
BUCKET_BYTES = 12 << 20
PLACE_BITS = U64(23)  # of a chunk's words in a packed minimum


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each run of `length` values; the last length-1 places are of shorter runs."""
    part, size = values, 1
    while size * 2 <= length:
        moved = part.copy()
        moved[: len(part) - size] = part[size:]
        part, size = np.minimum(part, moved), size * 2
    if size < length:
        moved = part.copy()
        moved[: max(0, len(part) - (length - size))] = part[length - size :]
        part = np.minimum(part, moved)
    return part


class Batch:
    """Words of a batch of documents, their windows and anchors."""

    def __init__(self, texts: list[bytes | None], window: int, gram: int):
        words, self.counts = common.split_words(texts)
        self.hashes = common.word_hashes(words)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.starts = np.flatnonzero(common.within(self.counts, window))  # of windows
        self.first = np.cumsum(self.counts) - self.counts
        self.grams = common.poly(self.hashes, gram)
        if len(self.hashes) >= 1 << int(PLACE_BITS):  # one very long text: minima in two steps would be needed; keep whole hashes aside
            order = np.argsort(self.grams, kind="stable")
            rank = np.empty(len(order), U64)
            rank[order] = np.arange(len(order), dtype=U64)
            least = sliding_min(rank, window - gram + 1)
            self.anchor = order[least[self.starts].astype(np.int64)]
        else:
            place = (U64(1) << PLACE_BITS) - U64(1)
            least = sliding_min(self.grams & ~place | np.arange(len(self.grams), dtype=U64), window - gram + 1)
            self.anchor = (least[self.starts] & place).astype(np.int64)


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, id); of that, where keys start and whether their documents differ."""
    order = np.lexsort((ids, keys))
    start, times = common.runs(keys[order])
    several = ids[order][start] != ids[order][start + times - 1] if len(start) else np.zeros(0, bool)
    return order, start, times, several


def _rows(kind: list, n_buckets: int) -> pa.RecordBatch:
    names = ["bucket", "local", "ids", "counts", "keys", "places"]
    columns = list(zip(*kind, strict=True)) if kind else [[]] * 6
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


PACKED = "bucket int, local boolean, ids binary, counts binary, keys binary, places binary"


def _pack(doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, places: np.ndarray, bucket: np.ndarray, n_buckets: int, local: bool, rows: list) -> None:
    for b, (d, k, p) in common.packed(bucket, n_buckets, [doc, keys, places]):
        order = np.argsort(d, kind="stable")
        d = d[order]
        start, times = common.runs(d)
        rows.append((b, local, ids[d[start]].tobytes(), times.astype(np.int32).tobytes(), k[order].tobytes() if not local else b"", p[order].tobytes()))


def _collapse(doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, places: np.ndarray, n_buckets: int, rows: list, smaller: bool) -> None:
    """Send one entry for each distinct key of the batch. Entries whose answer the batch knows become local rows: with `smaller`, those with a smaller id in the batch; otherwise all of keys that several ids of the batch have."""
    order, start, times, several = _distinct(keys, ids[doc])
    known = np.zeros(len(order), bool)
    if len(order):
        first = np.repeat(ids[doc][order][start], times)
        known = ids[doc][order] > first if smaller else np.repeat(several, times)
    sent = order[start]
    bucket = (keys[sent] >> U64(32)) * U64(n_buckets) >> U64(32)
    if smaller:
        # All rows of the least document of a key are sent: repeats inside one document stand or fall together.
        same = order[~known]
        bucket = ((keys[same] >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)
        _pack(doc[same], ids, keys[same], places[same], bucket, n_buckets, False, rows)
    else:
        # A key that the batch itself shows to be shared is sent with place 1, as known.
        flag = several.astype(np.uint32)
        _pack(doc[sent], ids, keys[sent], flag, bucket.astype(np.int64), n_buckets, False, rows)
    local = order[known]
    if len(local):
        where = (common.fmix(ids[doc[local]].astype(U64)) >> U64(32)) * U64(n_buckets) >> U64(32)
        value = places[local] if smaller else (keys[local] & U64(0xFFFFFFFF)).astype(np.uint32)
        _pack(doc[local], ids, keys[local], value, where.astype(np.int64), n_buckets, True, rows)


def _read(part: pa.Table, local: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = part.filter(part.column("local") if local else pc.invert(part.column("local")))
    ids = np.repeat(common.gather(own.column("ids").to_pylist(), np.int64), common.gather(own.column("counts").to_pylist(), np.int32))
    return ids, common.gather(own.column("keys").to_pylist(), np.uint64), common.gather(own.column("places").to_pylist(), np.uint32)


def _by_document(ids: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.lexsort((values, ids))
    ids, values = ids[order], values[order]
    start, times = common.runs(ids)
    blobs = [values[i : i + n].tobytes() for i, n in zip(start.tolist(), times.tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(ids[start], pa.int64()), "found": pa.array(blobs, pa.binary())})


def _shared_anchors(part: pa.Table) -> pa.Table:
    """(doc_id, low halves of its anchors that another document has too)."""
    part = common.eased(part)
    ids, keys, flags = _read(part, False)
    order, start, times, several = _distinct(keys, ids)
    live = np.repeat(several, times)
    if len(order):
        live |= np.repeat(np.maximum.reduceat(flags[order], start) > 0, times)
    ids, keys = ids[order][live], (keys[order][live] & U64(0xFFFFFFFF)).astype(np.uint32)
    more, _, low = _read(part, True)
    return _by_document(np.concatenate([ids, more]), np.concatenate([keys, low]))


def _repeated_windows(part: pa.Table) -> pa.Table:
    """(doc_id, starts of its windows that a smaller document has)."""
    part = common.eased(part)
    ids, keys, places = _read(part, False)
    order, start, times, _ = _distinct(keys, ids)
    cut = ids[order] > np.repeat(ids[order][start], times) if len(order) else np.zeros(0, bool)
    more, _, at = _read(part, True)
    return _by_document(np.concatenate([ids[order][cut], more]), np.concatenate([places[order][cut], at]))


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(common.quoted(doc_id).cast("long").alias("doc_id"), common.binary(text).alias("text"))


def _united(found: DataFrame, name: str, window: int = 0) -> DataFrame:
    """One row per document: its values, or the spans that windows starting there cover."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for parts in batch.column("found").to_pylist():
                at = np.unique(common.gather(parts, np.uint32))
                if window:
                    step = np.flatnonzero(np.diff(at) > window)
                    at = np.stack([at[np.append(0, step + 1)], at[np.append(step, len(at) - 1)] + window], 1).astype(np.uint32)
                blobs.append(at.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("found_id"), pa.array(blobs, pa.binary())], names=["found_id", "found"])

    grouped = found.groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_list("found").alias("found"))
    return common.table(grouped.mapInArrow(unite, "found_id long, found binary"), name)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(found_id, found): packed spans [start, stop) of a document's words that windows cover which a smaller one has too."""
    spark = common.tune(docs.sparkSession)
    n_buckets = common.bucket_count(common.input_bytes(docs), BUCKET_BYTES, least=48)
    source = _source(docs, text, doc_id).where("doc_id is not null")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches):
            batch, rows = Batch(table.column("text").to_pylist(), window, gram), []
            at = np.unique(batch.anchor)
            _collapse(batch.doc[at], common.int64s(table.column("doc_id")), batch.grams[at], np.zeros(len(at), np.uint32), n_buckets, rows, smaller=False)
            yield _rows(rows, n_buckets)

    anchors = _united(source.mapInArrow(seeds, PACKED).groupBy("bucket").applyInArrow(_shared_anchors, "doc_id long, found binary"), "anchors")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches):
            batch, rows = Batch(table.column("text").to_pylist(), window, gram), []
            low = (batch.grams[batch.anchor] & U64(0xFFFFFFFF)).astype(np.uint32)
            doc = batch.doc[batch.starts]
            live = np.zeros(len(doc), bool)
            edges = np.searchsorted(doc, np.arange(table.num_rows + 1))
            for i, blobs in enumerate(table.column("found").to_pylist()):
                a, b = int(edges[i]), int(edges[i + 1])
                if a < b:
                    live[a:b] = np.isin(low[a:b], np.frombuffer(blobs, np.uint32))
            starts = batch.starts[live]
            hashes = common.poly(batch.hashes, window, base=0xD6E8FEB86659FD93)[starts]
            own = batch.doc[starts]
            _collapse(own, common.int64s(table.column("doc_id")), hashes, (starts - batch.first[own]).astype(np.uint32), n_buckets, rows, smaller=True)
            yield _rows(rows, n_buckets)

    wanted = common.sized(anchors, blob="found")
    seeded = source.join(wanted, source.doc_id == wanted.found_id).select("doc_id", "text", "found")
    return _united(seeded.mapInArrow(extend, PACKED).groupBy("bucket").applyInArrow(_repeated_windows, "doc_id long, found binary"), "repeats", window)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", digests_only: bool = False) -> DataFrame:
    """docs with repeats cut from the text, and n_words, n_removed, kept_sha256 (of kept words joined by one space), repeats (word spans that went).

    A text that loses nothing stays as it is; otherwise its kept words are joined by one space. Columns of these names
    in docs are replaced. digests_only leaves text and spans out.
    """
    added = ["n_words", "n_removed", "kept_sha256", "repeats"]
    repeats = repeated_windows(docs, window, gram, text, doc_id)
    at, spans_of = common.free_name(docs, "found_id"), common.free_name(docs, "found")
    wanted = common.sized(repeats.select(F.col("found_id").alias(at), F.col("found").alias(spans_of)), blob=spans_of)
    kept = [c for c in docs.columns if c == text or c.lower() not in added]  # numbered on the way, so names of any kind will do
    numbered = [(common.binary(c) if c == text else common.quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)]
    source = docs.join(wanted, common.quoted(doc_id).cast("long") == F.col(at), "left").select(*numbered, F.col(spans_of).alias("found"))
    body = f"c{kept.index(text)}"
    carried = source.drop("found", body) if digests_only else source.drop("found")
    extra = "n_words long, n_removed long, kept_sha256 string" + ("" if digests_only else ", repeats array<struct<start: long, stop: long>>")
    schema = common.extended(carried.schema, extra)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches, body):
            n_words, n_removed, digest, spans, texts = [], [], [], [], []
            for raw, blobs in zip(table.column(body).to_pylist(), table.column("found").to_pylist(), strict=True):
                words = (raw or b"").split()
                gone, new = [], raw
                if blobs:
                    gone = np.frombuffer(blobs, np.uint32).reshape(-1, 2).tolist()
                    left, i = [], 0
                    for a, b in gone:
                        left += words[i:a]
                        i = b
                    left += words[i:]
                    new = b" ".join(left)
                    n_removed.append(len(words) - len(left))
                    digest.append(hashlib.sha256(new).hexdigest())
                else:
                    n_removed.append(0)
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                n_words.append(len(words))
                if not digests_only:
                    spans.append([{"start": a, "stop": b} for a, b in gone])
                    texts.append(new)
            out = table.drop_columns(["found"])
            out = out.drop_columns([body]) if digests_only else out.set_column(out.column_names.index(body), body, pa.array(texts, pa.binary()))
            out = out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column("kept_sha256", pa.array(digest, pa.string()))
            if not digests_only:
                out = out.append_column("repeats", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
            yield from out.to_batches()

    back = [(F.col(f"c{i}").cast("string") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(kept) if not (digests_only and c == text)]
    return source.mapInArrow(cut, schema).select(*back, *(x for x in added if not (digests_only and x == "repeats")))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: words, removed words and the digest of what is kept, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, digests_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
