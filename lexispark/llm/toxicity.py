"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and their first four and five letters, each hashed to one of 2^18 places. Of all
labelled learning rows the documents with a term are counted by label, and the terms whose counts depart most from
chance (the G statistic) become the machine's inputs. Score = logistic(w0 + sum of w_i + sum over pairs of <v_i, v_j>):
the linear part sees single terms, the factors see pairs such as an insult with the mention of a group. Words that matter
in company only would never be inputs that way, so a first machine's errors are added up over all pairs of words up to
REACH apart (the score test of a pair as one more input), and the words of the pairs that explain most of them join the
inputs of the machine that is kept.

Bounds: the machine has at most TERMS + 2 * PAIRS inputs with FACTORS factors each. It is fitted, and pairs are tested, on
about SAMPLE_ROWS learning rows, drawn by a hash of the id (the counts behind the choice of terms are of all of them).

Defined results: null and empty texts score as texts without terms; without learning rows of both labels every score is
0.0; rows without an id are not learned from; of repeated labels the largest counts; input columns named like the
output's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

PLACES_BITS = 18
TERMS = 4096
FACTORS = 8
SAMPLE_ROWS = 20_000
EPOCHS = 12
LEAST_G = 12.0
THRESHOLD = 0.3
#: Pairs of words: how far apart, places that they are hashed to, how many may join, least score statistic and documents.
REACH, PAIR_BITS, PAIRS, LEAST_PAIR, PAIR_DOCS = 6, 20, 64, 40.0, 12
#: Bytes of text whose pairs are held at once: each word is in REACH of them.
PAIR_CHUNK = 1 << 19
CACHE_RUNS = 200_000
SLICES = 16


def terms_of(run: str) -> list[int]:
    """Places of a run's terms."""
    found = ["w" + run]
    if len(run) >= 4:
        found.append("4" + run[:4])
    if len(run) >= 5:
        found.append("5" + run[:5])
    return [xxhash.xxh32_intdigest(t) >> (32 - PLACES_BITS) for t in found]


class Terms:
    """Distinct inputs of texts, with a cache by run. inputs maps places to input numbers; -1 is no input."""

    def __init__(self, inputs: np.ndarray):
        self.inputs, self.cache = inputs, common.Cache(CACHE_RUNS)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined, starts, lengths, hashes, counts = common.letter_runs([t.lower() for t in texts])
        inputs = lambda run: [x for x in self.inputs[terms_of(run)].tolist() if x >= 0]
        make = lambda new: common.end_to_end([inputs(joined[i : i + n]) for i, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)])
        ids, times = self.cache.take(hashes, make)
        doc = np.repeat(np.repeat(np.arange(len(texts)), counts), times)
        both = np.unique(doc << 32 | ids.astype(np.int64))
        return np.split(both & 0xFFFFFFFF, np.searchsorted(both >> 32, np.arange(1, len(texts))))


class Machine:
    """A factorization machine on sets of inputs."""

    def __init__(self, n: int, factors: int = FACTORS, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, factors))

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        out = np.full(len(sets), self.w0)
        some = np.flatnonzero(size)
        if len(some):
            ids = np.concatenate(sets).astype(np.int64)
            start = (np.cumsum(size) - size)[some]
            v = self.v[ids]
            both = np.add.reduceat(v, start) ** 2 - np.add.reduceat(v * v, start)
            out[some] += np.add.reduceat(self.w[ids], start) + 0.5 * both.sum(1)
        return out

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(sets), -40, 40)))

    def fit(self, sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, seed: int = 11) -> Machine:
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
        g0, gw, gv = 1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(sets))
            for i in range(0, len(order), 64):
                part = order[i : i + 64]
                own = [sets[j] for j in part]
                error = self.score(own) - labels[part]
                size = np.fromiter(map(len, own), np.int64, len(own))
                g0 += (d := error.mean()) ** 2
                self.w0 -= rate * d / np.sqrt(g0)
                if not size.sum():
                    continue
                ids = np.concatenate(own).astype(np.int64)
                each = np.repeat(error, size)
                some = np.flatnonzero(size)
                sums = np.zeros((len(own), self.v.shape[1]))
                sums[some] = np.add.reduceat(self.v[ids], (np.cumsum(size) - size)[some])
                used, where = np.unique(ids, return_inverse=True)
                dw = np.bincount(where, each) / len(own) + l2 * self.w[used]
                slope = each[:, None] * (np.repeat(sums, size, 0) - self.v[ids])
                dv = np.zeros((len(used), self.v.shape[1]))
                np.add.at(dv, where, slope)
                dv = dv / len(own) + l2 * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
        return self


def g_statistic(with_term: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """G of each term from documents with it by label (2 rows) and documents by label, with half a document added to each cell."""
    cells = np.stack([with_term, totals[:, None] - with_term]) + 0.5
    expected = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / cells.sum((0, 1))
    return 2 * (cells * np.log(cells / expected)).sum((0, 1))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, Machine] | None:
    """(input number of each place, machine) from the documents that labels names, or None if they don't show both labels."""
    common.tune(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_label_id")).agg(F.max(label).cast("int").alias("label"))
    source = docs.select(common.quoted(doc_id).alias("_doc_id"), common.binary(text).alias("text")).join(common.sized(known), F.col("_doc_id") == F.col("_label_id")).select("_label_id", "label", "text")
    size = 1 << PLACES_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, totals = Terms(np.arange(size)), np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for table in common.chunks(batches):
            own = table.column("label").to_numpy()
            sets = terms.of(common.decoded(table.column("text").to_pylist()))
            for y in (0, 1):
                mine = [s for s, l in zip(sets, own, strict=True) if l == y]
                totals[y] += len(mine)
                if mine:
                    counts[y] += np.bincount(np.concatenate(mine), minlength=size)
        if totals.sum():
            width = size // SLICES
            for i in range(SLICES):
                part = counts[:, i * width : (i + 1) * width]
                at = np.flatnonzero(part.any(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.tobytes()]), pa.array([np.ascontiguousarray(part[:, at]).tobytes()]), pa.array([totals.tobytes()])], names=["slice", "places", "counts", "totals"])

    def add(part: pa.Table) -> pa.Table:
        total, counts = np.zeros(2, np.int64), np.zeros((2, size // SLICES), np.int64)
        for at, c, t in zip(*(part.column(x).to_pylist() for x in ("places", "counts", "totals")), strict=True):
            counts[:, np.frombuffer(at, np.int32)] += np.frombuffer(c, np.int64).reshape(2, -1)
            total += np.frombuffer(t, np.int64)
        return pa.table({"slice": part.column("slice").slice(0, 1), "counts": pa.array([counts.tobytes()]), "totals": pa.array([total.tobytes()])})

    summed = source.mapInArrow(count, "slice int, places binary, counts binary, totals binary").groupBy("slice").applyInArrow(add, "slice int, counts binary, totals binary").collect()
    if not summed or not (totals := np.frombuffer(summed[0]["totals"], np.int64)).all():
        return None
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64).reshape(2, -1) for r in sorted(summed, key=lambda r: r.slice)], 1)
    g = g_statistic(counts, totals)
    best = np.argsort(-g, kind="stable")[:TERMS]
    best = np.sort(best[g[best] >= LEAST_G])
    inputs = np.full(size, -1, np.int64)
    inputs[best] = np.arange(len(best))
    share = min(1.0, SAMPLE_ROWS / int(totals.sum()))  # a bounded sample to fit on, whatever the texts
    drawn = source.where(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else source
    sample = common.table(drawn.select("label", "text"), "sample")
    machine = fitted(sample, inputs)
    more = np.setdiff1d(paired_terms(sample, inputs, machine), np.flatnonzero(inputs >= 0))
    if len(more):
        inputs[more] = np.arange(len(best), len(best) + len(more))
        machine = fitted(sample, inputs)
    return inputs, machine


def fitted(sample: DataFrame, inputs: np.ndarray) -> Machine:
    """A machine for these inputs, from the rows (label, text) of the sample: their input numbers come to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast(inputs)

    def inputs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value)
        for table in common.chunks(batches):
            sets = terms.of(common.decoded(table.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([table.column("label").combine_chunks(), pa.array([s.astype(np.int32).tobytes() for s in sets], pa.binary())], names=["label", "inputs"])

    rows = sorted((r["inputs"], r["label"]) for r in sample.mapInArrow(inputs_of, "label int, inputs binary").collect())  # in an order that no partition decides
    sets = [np.frombuffer(x, np.int32).astype(np.int64) for x, _ in rows]
    return Machine(int(inputs.max(initial=-1)) + 1).fit(sets, np.array([y for _, y in rows], float))


class Pairs:
    """Distinct pairs of words up to REACH apart in texts."""

    def __init__(self):
        self.cache = common.Cache(CACHE_RUNS)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the one word, place of the other) of each pair, smaller place first."""
        joined, starts, lengths, hashes, counts = common.letter_runs([t.lower() for t in texts])
        make = lambda new: common.end_to_end([terms_of(joined[i : i + n])[:1] for i, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)])
        word = self.cache.take(hashes, make)[0].astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        parts = []
        for d in range(1, REACH + 1):
            a, b = word[:-d], word[d:]
            same = (doc[:-d] == doc[d:]) & (a != b)
            a, b = a[same], b[same]
            parts.append(doc[:-d][same] << 2 * PLACES_BITS | np.minimum(a, b) << PLACES_BITS | np.maximum(a, b))
        both = np.unique(np.concatenate(parts))
        mask = (1 << PLACES_BITS) - 1
        return both >> 2 * PLACES_BITS, both >> PLACES_BITS & mask, both & mask


def pair_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (common.fmix((a << PLACES_BITS | b).astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def paired_terms(sample: DataFrame, inputs: np.ndarray, machine: Machine) -> np.ndarray:
    """Places of the words whose pairs explain most of what the machine gets wrong in the sample."""
    shared = sample.sparkSession.sparkContext.broadcast((inputs, machine))
    width = (1 << PAIR_BITS) // SLICES

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        terms, pairs, sums = Terms(known), Pairs(), np.zeros((3, 1 << PAIR_BITS), np.float32)
        for table in common.chunks(batches, limit=PAIR_CHUNK):
            texts = common.decoded(table.column("text").to_pylist())
            p = model.score(terms.of(texts))
            doc, a, b = pairs.of(texts)
            at = pair_places(a, b)
            for row, own in zip(sums, (table.column("label").to_numpy() - p, p * (1 - p), np.ones(len(p))), strict=True):
                row += np.bincount(at, own[doc], len(row)).astype(np.float32)
        for i in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.ascontiguousarray(sums[:, i * width : (i + 1) * width]).tobytes()])], names=["slice", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in part.column("sums").to_pylist())
        error, spread, docs = total.reshape(3, -1)
        z = np.where(docs >= PAIR_DOCS, error**2 / (spread + 1), 0.0)
        at = np.argsort(-z, kind="stable")[: 4 * PAIRS]
        at = at[z[at] >= LEAST_PAIR]
        return pa.table({"place": pa.array(at + part.column("slice")[0].as_py() * width, pa.int64()), "z": pa.array(z[at], pa.float64())})

    best = sample.coalesce(8).mapInArrow(errors, "slice int, sums binary").groupBy("slice").applyInArrow(add, "place long, z double").orderBy(F.desc("z"), "place").limit(PAIRS).collect()
    if not best:
        return np.zeros(0, np.int64)
    wanted = np.sort([r.place for r in best])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs()
        for table in common.chunks(batches, limit=PAIR_CHUNK):
            _, a, b = pairs.of(common.decoded(table.column("text").to_pylist()))
            at = pair_places(a, b)
            here = np.isin(at, wanted)
            yield pa.RecordBatch.from_arrays([pa.array(x[here], pa.int64()) for x in (at, a, b)], names=["place", "a", "b"])

    counted = sample.mapInArrow(words, "place long, a long, b long").groupBy("place", "a", "b").agg(F.count("*").alias("n"))
    first = counted.groupBy("place").agg(F.max(F.struct("n", "a", "b")).alias("most")).collect()  # a pair for each of the places
    return np.unique([x for r in first for x in (r.most.a, r.most.b)])


def score(docs: DataFrame, learned: tuple[np.ndarray, Machine] | None, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with score and predicted; a map over rows."""
    spark = common.tune(docs.sparkSession)
    if learned is None:
        kept = [common.quoted(c) for c in docs.columns if c.lower() not in ("score", "predicted") and (keep_text or c != text)]
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(learned)

    def start():
        inputs, machine = shared.value
        terms = Terms(inputs)

        def make(texts: list[bytes | None]) -> list[pa.Array]:
            own = machine.score(terms.of(common.decoded(texts)))
            return [pa.array(own), pa.array((own >= threshold).astype(np.int32))]

        return make

    return common.added_columns(docs, text, "score double, predicted int", start, keep_text)


def fold(column: str = "doc_id", parts: int = 4):
    """crc32 of an id's digits, modulo parts; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def query(spark, sf_dir: str) -> DataFrame:
    """op7: toxicity of every document, learned from labels of the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold() != 2)
    learned = learn(docs, labels)
    held = F.coalesce(fold() == 2, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", held, "text"), learned, keep_text=False).select("doc_id", "held_out", "score", "predicted")
