"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are TF-IDF vectors over hashed words; the weights come from the document counts of the whole corpus. A
randomised SVD of these vectors, its products summed over partitions, gives a basis of their row space. Passages of
documents (32 words, every 16 words) are projected on it and compared with all items by cosine. Passages that cannot
reach the least cosine are left out by an exact bound: what a projection keeps is at most the weight that a passage has
on words of the benchmark. Around each candidate the longest common subsequence with the item's words is measured:
NEAR of them in order is a leak, LOOSE of them is one if the answer (the item's last sentence) is there as well. Items much
longer than a window are cut into parts of its length for the retrieval, and verified as a whole. Word for word copies of
items of any length are found apart from all cosines: by the item's rarest word and a hash of its word sequence.

Bounds: items' parts are taken in blocks of ITEM_BLOCK, fewer than RANK, so a block's basis holds all of its items whole and the
cosines are exact however large the benchmark is. A worker holds up to HELD_BLOCKS blocks; of more it loads one at a time.
Time grows with the number of blocks. The table of weights has 2^20 places, whatever the corpus. Documents are only mapped
over; nothing of them is shuffled but counts.

Defined results: null and empty texts are clean; items without words or text match nothing; items of under 8 words count
only if they stand there word for word; repeated rows are kept and judged alike; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

PLACES_BITS = 20
WINDOW, STRIDE = 32, 16
LEAST_COSINE = 0.4
NEAR, LOOSE, ANSWER = 0.75, 0.55, 0.5
SHORT = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
RANK = 256
#: Parts of items in a block. A basis of a rank below their number would lose most of an item, and with it its exact copies.
ITEM_BLOCK = RANK - 8
HELD_BLOCKS = 8
#: Signs that are taken out of texts and items before words are compared.
SIGNS = b".,;:!?\"'()[]{}*#%&$-_"
SLICES = 32


def plain(text: str | bytes | None) -> bytes:
    raw = text.encode() if isinstance(text, str) else (text or b"")
    return raw.lower().translate(None, SIGNS)


def words_of(text: str | bytes | None) -> list[bytes]:
    return plain(text).split()


def places_of(words: list[bytes]) -> np.ndarray:
    """Places of words in the hashed vocabulary."""
    return (common.word_hashes(words) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)


def chunk_places(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words, counts = common.split_words([plain(t) for t in texts])
    return words, places_of(words), counts


def document_weights(docs: DataFrame, text: str) -> np.ndarray:
    """Inverse document frequency of every place, over all rows of docs."""
    size = 1 << PLACES_BITS
    width = size // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for table in common.chunks(batches):
            _, at, counts = chunk_places(table.column("text").to_pylist())
            doc = np.repeat(np.arange(len(counts)), counts)
            total += np.bincount(np.unique(doc << PLACES_BITS | at) & (size - 1), minlength=size)
            n += table.num_rows
        for i in range(SLICES if n else 0):
            part = total[i * width : (i + 1) * width]
            at = np.flatnonzero(part).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([at.tobytes()]), pa.array([part[at].astype(np.int32).tobytes()])], names=["slice", "n", "places", "counts"])

    def add(part: pa.Table) -> pa.Table:
        out = np.zeros(width, np.int64)
        for at, c in zip(part.column("places").to_pylist(), part.column("counts").to_pylist(), strict=True):
            out[np.frombuffer(at, np.int32)] += np.frombuffer(c, np.int32)
        return pa.table({"slice": part.column("slice").slice(0, 1), "n": pa.array([sum(part.column("n").to_pylist())], pa.int64()), "counts": pa.array([out.tobytes()])})

    rows = docs.select(common.binary(text).alias("text")).mapInArrow(count, "slice int, n long, places binary, counts binary").groupBy("slice").applyInArrow(add, "slice int, n long, counts binary").collect()  # one row per slice
    counts, n = np.zeros(size, np.int64), 0
    for r in rows:
        counts[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
        n = r["n"]
    return np.log((n + 1) / (counts + 1)).astype(np.float32) + np.float32(0.1)


def random_rows(places: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Rows of the random test matrix, made from the places themselves: no task needs to be sent any."""
    grid = common.fmix(places.astype(np.uint64)[:, None] * np.uint64(rank) + np.arange(rank, dtype=np.uint64) + np.uint64(seed << 40))
    return np.where(grid & np.uint64(1 << 17), 1.0, -1.0).astype(np.float32)


def sparse_rows(texts: list[bytes | None], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows: (places, values)."""
    out = []
    for text in texts:
        at, times = np.unique(places_of(words_of(text)), return_counts=True)
        values = times * weights[at].astype(np.float64)
        out.append((at, values / (np.linalg.norm(values) or 1.0)))
    return out


def basis_of(items: DataFrame, weights_shared, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary places, basis): orthonormal columns over the items' words that span the range of A'A times a random matrix."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = weights_shared.value
        for batch in batches:
            rows = sparse_rows(batch.column("text").to_pylist(), weights)
            if not any(len(at) for at, _ in rows):
                continue
            vocabulary = np.unique(np.concatenate([at for at, _ in rows]))
            out = np.zeros((len(vocabulary), rank), np.float32)
            for at, values in rows:
                y = values.astype(np.float32) @ random_rows(at, rank)
                out[np.searchsorted(vocabulary, at)] += values.astype(np.float32)[:, None] * y
            for i in range(SLICES):
                own = vocabulary % SLICES == i
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([vocabulary[own].tobytes()]), pa.array([out[own].tobytes()])], names=["slice", "places", "cells"])

    def add(part: pa.Table) -> pa.Table:
        at = common.gather(part.column("places").to_pylist(), np.int64)
        cells = common.gather(part.column("cells").to_pylist(), np.float32).reshape(-1, rank)
        found, where = np.unique(at, return_inverse=True)
        out = np.zeros((len(found), rank), np.float32)
        np.add.at(out, where, cells)
        return pa.table({"slice": part.column("slice").slice(0, 1), "places": pa.array([found.tobytes()]), "cells": pa.array([out.tobytes()])})

    rows = items.select("text").mapInArrow(product, "slice int, places binary, cells binary").groupBy("slice").applyInArrow(add, "slice int, places binary, cells binary").collect()  # the words of one block's items, times rank
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, rank), np.float32)
    at = np.concatenate([np.frombuffer(r["places"], np.int64) for r in rows])
    cells = np.concatenate([np.frombuffer(r["cells"], np.float32).reshape(-1, rank) for r in rows])
    order = np.argsort(at)
    q, r = np.linalg.qr(cells[order].astype(np.float64))
    solid = np.abs(np.diag(r)) > 1e-6 * max(1e-30, np.abs(np.diag(r)).max())
    return at[order], q[:, solid].astype(np.float32)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        both = row & masks.get(y, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence."""
    parts = [p for p in (words_of(x) for x in re.split(r"[.?!\n]+(?:\s|$)", text or "")) if p]
    return parts[-1] if parts else []


def best_match(item: list[bytes], region: list[bytes], answer: list[bytes]) -> float:
    """Share of the item's words that the region has in order, or 0.0 if that is no leak."""
    share = lcs(item, region) / len(item)
    if share >= NEAR:
        return share
    return share if share >= LOOSE and answer and lcs(answer, region) >= ANSWER * len(answer) else 0.0


class Passages:
    """Passages of a chunk of documents: the document, start in it and first word's number of each, words' weights and running sequence hashes."""

    def __init__(self, at: np.ndarray, counts: np.ndarray, weights: np.ndarray, hashes: np.ndarray):
        self.counts, self.ends = counts, np.cumsum(counts)
        self.powers = powers(len(at))
        self.sequence = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers, dtype=np.uint64)])
        first = self.ends - counts
        number = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
        self.doc = np.repeat(np.arange(len(counts)), number)
        step = np.arange(len(self.doc)) - np.repeat(np.cumsum(number) - number, number)
        self.start = np.minimum(step * STRIDE, np.maximum(counts[self.doc] - WINDOW, 0))
        self.length = np.minimum(WINDOW, counts[self.doc])
        self.a = first[self.doc] + self.start
        self.at, self.weight = at, weights[at]
        self.square = self.weight.astype(np.float64) ** 2
        self.full = self.sums(self.square)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each passage."""
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[self.a + self.length] - total[self.a]


def parts_of(words: list[bytes]) -> list[bytes]:
    """What the retrieval compares with windows: an item of up to two windows as it is, a longer one in even parts, none of a short one."""
    n = len(words)
    number = 1 if n <= 2 * WINDOW else -(-n // WINDOW)
    return [b" ".join(words[n * i // number : n * (i + 1) // number]) for i in range(number)] if n >= SHORT else []


def powers(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base of sequence hashes, modulo 2^64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), BASE)]), dtype=np.uint64)[:n]


class Sequences:
    """Word sequences, found word for word: by the place of each one's rarest word, then by its hash."""

    def __init__(self, sequences: list[list[bytes]], weights: np.ndarray):
        number = np.array([j for j, words in enumerate(sequences) if words], np.int64)
        hashes = [common.word_hashes(sequences[j]) for j in number.tolist()]
        places = [places_of(sequences[j]) for j in number.tolist()]
        offset = np.array([int(weights[x].argmax()) for x in places], np.int64)
        place = np.array([int(x[o]) for x, o in zip(places, offset.tolist(), strict=True)], np.int64)
        order = np.argsort(place, kind="stable")
        self.number, self.offset = number[order], offset[order]
        self.length = np.array([len(x) for x in hashes], np.int64)[order]
        self.hash = np.array([(x * powers(len(x))).sum(dtype=np.uint64) for x in hashes], np.uint64)[order]
        self.first, self.count = common.runs(place[order])
        self.place = place[order][self.first]

    def hits(self, p: Passages) -> Iterator[tuple[int, int, int]]:
        """(document, number of its first word in the chunk, sequence) wherever the hash of a sequence stands within a document."""
        which = np.full(1 << PLACES_BITS, -1, np.int32)
        which[self.place] = np.arange(len(self.place))
        which = which[p.at]
        spots = np.flatnonzero(which >= 0)
        for i in range(0, len(spots), 1 << 14):
            spot = spots[i : i + (1 << 14)]
            k = which[spot]
            entry = common.spread(np.arange(len(self.number)), self.first[k], self.count[k])
            spot = np.repeat(spot, self.count[k])
            begin = spot - self.offset[entry]
            doc = np.searchsorted(p.ends, spot, side="right")
            inside = (begin >= p.ends[doc] - p.counts[doc]) & (begin + self.length[entry] <= p.ends[doc])
            begin, entry, doc = begin[inside], entry[inside], doc[inside]
            same = p.sequence[begin + self.length[entry]] - p.sequence[begin] == self.hash[entry] * p.powers[begin]
            yield from zip(doc[same].tolist(), begin[same].tolist(), self.number[entry[same]].tolist(), strict=True)


class Index:
    """A block of items and their parts: basis, coordinates, words and answers."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: np.ndarray, basis: np.ndarray, weights: np.ndarray, parts: list[list[bytes]] | None = None):
        parts = [parts_of(words_of(t)) for _, t in items] if parts is None else parts
        texts = [x for own in parts for x in own]
        self.owner = np.repeat(np.arange(len(items)), [len(own) for own in parts])
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.answers = [answer_of(t) for _, t in items]
        self.sequences = Sequences(self.words, weights)
        self.vocabulary = vocabulary
        coordinates = np.zeros((len(texts), basis.shape[1]), np.float64)
        for i, (at, values) in enumerate(sparse_rows(texts, weights)):
            coordinates[i] = values @ basis[np.searchsorted(vocabulary, at)].astype(np.float64) if len(at) else 0.0
        # The SVD proper: rotate the basis to the right singular vectors.
        _, sigma, rotation = np.linalg.svd(coordinates, full_matrices=False) if len(texts) else (None, np.zeros(0), np.zeros((0, basis.shape[1])))
        keep = sigma > 1e-6
        self.sigma, rotation = sigma[keep], rotation[keep].T
        self.basis = np.concatenate([(basis.astype(np.float64) @ rotation), np.zeros((1, int(keep.sum())))]).astype(np.float32)
        coordinates = coordinates @ rotation
        length = np.linalg.norm(coordinates, axis=1, keepdims=True)
        self.items = (coordinates / np.where(length > 0, length, 1.0)).astype(np.float32)

    def candidates(self, p: Passages) -> Iterator[tuple[int, int, int]]:
        """(document, start of the passage in it, item) of all passages and items whose cosine reaches the least one."""
        if not len(self.items):
            return
        row = np.full(1 << PLACES_BITS, -1, np.int32)
        row[self.vocabulary] = np.arange(len(self.vocabulary))
        row = row[p.at]
        within = p.sums(np.where(row >= 0, p.square, 0.0))
        some = np.flatnonzero((within >= LEAST_COSINE**2 * p.full) & (p.full > 0))
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            spots = p.a[part][:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < p.length[part][:, None]
            spots = np.where(inside, spots, 0)
            rows = np.where(inside, row[spots], -1)
            values = np.where(rows >= 0, p.weight[spots], np.float32(0))
            passage = np.einsum("ij,ijk->ik", values, self.basis[rows])
            cosine = passage @ self.items.T / np.sqrt(p.full[part])[:, None].astype(np.float32)
            for k, j in zip(*(x.tolist() for x in np.nonzero(cosine >= LEAST_COSINE)), strict=True):
                yield int(p.doc[part[k]]), int(p.start[part[k]]), int(self.owner[j])

    def leaks(self, words: list[bytes], counts: np.ndarray, passages: Passages) -> list[dict[int, float]]:
        """Per text: leaked items and the share of their words."""
        found: list[dict[int, float]] = [{} for _ in counts]
        first = np.cumsum(counts) - counts
        for doc, begin, j in self.sequences.hits(passages):
            item = self.words[j]
            if self.ids[j] not in found[doc] and words[begin : begin + len(item)] == item:
                found[doc][self.ids[j]] = 1.0
        seen: set[tuple[int, int, int]] = set()
        for doc, start, j in self.candidates(passages):
            item = self.words[j]
            if self.ids[j] in found[doc] or (doc, j, start // max(WINDOW, len(item))) in seen:
                continue
            seen.add((doc, j, start // max(WINDOW, len(item))))
            a, n = int(first[doc]), int(counts[doc])
            margin = max(WINDOW, len(item))
            region = words[a + max(0, start - margin) : a + min(n, start + WINDOW + 2 * margin)]
            if share := best_match(item, region, self.answers[j]):
                found[doc][self.ids[j]] = share
        return found


def blocks_of(items: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str, list[bytes]]]]:
    """Items with their parts in blocks of ITEM_BLOCK parts; an item without any counts as one, and one may lie in several blocks."""
    block: list[tuple[int, str, list[bytes]]] = []
    room = ITEM_BLOCK
    for i, text in items:
        parts = parts_of(words_of(text))
        for k in range(0, len(parts), ITEM_BLOCK) if parts else [0]:
            own = parts[k : k + ITEM_BLOCK]
            if block and max(1, len(own)) > room:
                yield block
                block, room = [], ITEM_BLOCK
            block.append((i, text, own))
            room -= max(1, len(own))
    if block:
        yield block


def judged(texts: list[bytes | None], weights, shared: list) -> list[dict[int, float]]:
    """Per text: items of all blocks that leaked, and the share of their words."""
    words, counts = common.split_words([plain(t) for t in texts])
    hashes = common.word_hashes(words)
    at = (hashes >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
    passages = Passages(at, counts, weights.value, hashes)
    found: list[dict[int, float]] = [{} for _ in texts]
    for block in shared:
        for own, more in zip(found, block.value.leaks(words, counts, passages), strict=True):
            for i, share in more.items():
                own[i] = max(share, own.get(i, 0.0))
        if len(shared) > HELD_BLOCKS:
            block.__dict__.pop("_value", None)  # read again from the worker's local copy for the next chunk
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with contaminated, leaked_items (ascending item ids) and leak_share (largest share); columns of these names are replaced."""
    spark = common.tune(docs.sparkSession)
    sc = spark.sparkContext
    weights = sc.broadcast(document_weights(docs, text))
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("item"))
    shared = []
    for block in blocks_of((r.id, r["item"]) for r in items.orderBy("id", "item").toLocalIterator()):
        parts = [own for _, _, own in block]
        texts = [(x,) for own in parts for x in own]
        basis = basis_of(spark.createDataFrame(texts, "text binary"), weights, len(texts) + 8)
        shared.append(sc.broadcast(Index([(i, t) for i, t, _ in block], *basis, weights.value, parts)))

    def start():
        def make(texts: list[bytes | None]) -> list[pa.Array]:
            found = judged(texts, weights, shared)
            shares = [max(f.values(), default=0.0) for f in found]
            return [pa.array([bool(f) for f in found], pa.bool_()), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array(shares, pa.float64())]

        return make

    return common.added_columns(docs, text, "contaminated boolean, leaked_items array<long>, leak_share double", start, keep_text)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: for every document, whether it holds a benchmark item, and which."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False).select("doc_id", "contaminated", "leaked_items", "leak_share")
