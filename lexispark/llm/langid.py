"""Language identification by interpolated Kneser-Ney character models.

Texts are runs of letters; each run is scored on its own, with a mark before and after it, so a model's answer for a run
depends on nothing else and can be kept. Characters become 12-bit codes, an n-gram of up to five of them and its order
one 64-bit key. Counting covers every learning row: batches count keys, buckets add the batches up. Continuation counts,
discounts and back-off weights follow from the counts; for every key that some language has, the interpolated log
probability in each language stands in a matrix beside the sorted keys. A document gets the language of lowest
cross-entropy per character; a temperature fitted on learning rows turns the entropies into a score, and documents whose
best entropy lies beyond what learning rows of that language show are marked as rejected.

Bounds: no n-gram is left out. Languages are taken in groups of at most MODEL_KEYS keys and MODEL_CELLS numbers (a larger
language is a group of its own), each group's model is broadcast on its own, and of several a worker holds one at a time;
so the driver and a worker need memory for the largest language. Temperature and rejection limits come from all learning
rows: partitions send sums.

Defined results: null texts and texts without letters are `und` with score 0; without learning rows everything is `und`;
rows without an id are not learned from and count as not held out; repeated rows are kept; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.common import U64

ORDER = 5
CODE_BITS = 12
MARK = 1  # code of a run's ends
MODEL_CELLS = 8_000_000
MODEL_KEYS = 1_500_000
CACHE_RUNS = 250_000
SHIFT = U64(CODE_BITS)
LOW = [U64((1 << (CODE_BITS * m)) - 1) for m in range(ORDER + 1)]
TAG = [U64(m) << U64(60) for m in range(ORDER + 1)]


def codes_of(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs with their marks, and the number of codes of each."""
    points = np.frombuffer("\n".join(runs).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32).astype(U64)
    codes = (common.fmix(points) % U64((1 << CODE_BITS) - 2)) + U64(2)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    ends = np.cumsum(lengths + 1) - 1  # the line feeds between runs become their end marks
    codes[ends] = MARK
    first = np.concatenate([[0], ends[:-1] + 1])
    return np.insert(codes, first, U64(MARK)), lengths + 2


def keys_of(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each predicted place: its run, the number of codes of history (its own included, ORDER at most), and the key of each order."""
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(offset > 0)
    have = np.minimum(offset[at] + 1, ORDER)
    value = codes[at]
    keys = [np.zeros(0, U64), value | TAG[1]]
    for m in range(2, ORDER + 1):
        value = value | codes[np.maximum(at - m + 1, 0)] << U64(CODE_BITS * (m - 1))
        keys.append(value | TAG[m])
    return np.repeat(np.arange(len(counts)), counts)[at], have, keys


def count_keys(runs: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the longest n-gram at each place of the runs."""
    if not runs:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    run, have, keys = keys_of(*codes_of(list(runs)))
    weight = np.fromiter(runs.values(), np.int64, len(runs))[run]
    longest = np.select([have == m for m in range(2, ORDER + 1)], keys[2:], U64(0))
    return add_up(longest, weight)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start, _ = common.runs(keys)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def order_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(60)).astype(np.int64)


def suffix(keys: np.ndarray, m: int) -> np.ndarray:
    """Without the first code."""
    return keys & LOW[m - 1] | TAG[m - 1]


def prefix(keys: np.ndarray, m: int) -> np.ndarray:
    """Without the last code: the context."""
    return (keys & LOW[m]) >> SHIFT | TAG[m - 1]


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


class Model:
    """Sorted keys per order, log probabilities of each language, and log back-off weights of contexts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        size = len(self.langs)
        adjusted: list[list] = [[None] * (ORDER + 1) for _ in self.langs]
        for i, lang in enumerate(self.langs):
            keys, times = counts[lang]
            order = order_of(keys)
            above = (keys[order == ORDER], times[order == ORDER])
            adjusted[i][ORDER] = above
            for m in range(ORDER - 1, 0, -1):
                own = order == m  # raw counts: these stand at the start of a run and have nothing before them
                left = suffix(above[0], m + 1)
                above = add_up(np.concatenate([left, keys[own]]), np.concatenate([np.ones(len(left), np.int64), times[own]]))
                adjusted[i][m] = above
        self.keys: list[np.ndarray] = [np.zeros(0, U64)]
        self.logs: list[np.ndarray] = [np.zeros((0, size), np.float32)]
        self.contexts: list[np.ndarray] = [np.zeros(0, U64)]
        self.backoff: list[np.ndarray] = [np.zeros((0, size), np.float32)]
        lower = np.full((1, size), 1.0 / (1 << CODE_BITS))
        for m in range(1, ORDER + 1):
            union = np.unique(np.concatenate([a[m][0] for a in adjusted]))
            contexts = np.unique(prefix(union, m))
            at_context = np.searchsorted(contexts, prefix(union, m))
            below = lower[np.searchsorted(self.keys[m - 1], suffix(union, m))] if m > 1 else np.repeat(lower, len(union), 0)
            weight, first = np.ones((len(contexts), size)), np.zeros((len(union), size))
            for i, a in enumerate(adjusted):
                keys, times = a[m]
                if not len(keys):
                    continue
                ones, twos = int((times == 1).sum()), int((times == 2).sum())
                discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5
                c = np.searchsorted(contexts, prefix(keys, m))
                total, kinds = np.bincount(c, times, len(contexts)), np.bincount(c, minlength=len(contexts))
                seen = total > 0
                weight[seen, i] = discount * kinds[seen] / total[seen]
                first[np.searchsorted(union, keys), i] = (times - discount) / total[c]
            lower = first + weight[at_context] * below
            self.keys.append(union)
            self.logs.append(np.log(lower).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(np.log(weight).astype(np.float32))

    def score_runs(self, runs: list[str]) -> np.ndarray:
        """Per run: log probability in each language, and the number of predicted characters."""
        codes, counts = codes_of(runs)
        run, have, keys = keys_of(codes, counts)
        out = np.zeros((len(run), len(self.langs)), np.float32)
        open_ = np.arange(len(run))
        for m in range(ORDER, 0, -1):
            try_ = open_[have[open_] >= m]
            at, hit = place(self.keys[m], keys[m][try_])
            out[try_[hit]] += self.logs[m][at[hit]]
            miss = try_[~hit]
            if len(miss):
                c, known = place(self.contexts[m], prefix(keys[m][miss], m))
                out[miss[known]] += self.backoff[m][c[known]]
            done = np.zeros(len(run), bool)
            done[try_[hit]] = True
            open_ = open_[~done[open_]]
        out[open_] -= np.float32(CODE_BITS * np.log(2))
        start = np.cumsum(counts - 1) - (counts - 1)
        return np.concatenate([np.add.reduceat(out, start), (counts - 1)[:, None].astype(np.float32)], 1)


class Scorer:
    """Broadcast models of groups of languages, with a cache of runs. Of several models one is held at a time."""

    def __init__(self, shared: list, size: int):
        self.shared, self.size = shared, size
        self.cache = common.Cache(CACHE_RUNS, np.float32, size + 1)

    def score_runs(self, runs: list[str]) -> np.ndarray:
        """As a model's, in the languages of all groups."""
        parts = []
        for group in self.shared:
            model = group.value
            parts.append(np.concatenate([model.score_runs(runs[i : i + 50_000]) for i in range(0, len(runs), 50_000)]))
            if len(self.shared) > 1:
                del model
                group.__dict__.pop("_value", None)  # read again from the worker's local copy when there are new runs
        return np.concatenate([*(x[:, :-1] for x in parts), parts[0][:, -1:]], 1)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text in each language; infinity for texts without letters."""
        size = self.size
        joined, starts, lengths, hashes, counts = common.letter_runs([t.lower() for t in texts], marks=True)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            runs = [joined[i : i + n] for i, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)]
            return self.score_runs(runs), np.ones(len(runs), np.int64)

        at = self.cache.numbers(hashes, make)
        out = np.full((len(texts), size), np.inf)
        some = np.flatnonzero(counts)
        if len(some):
            rows = self.cache.values[self.cache.starts[at]].astype(np.float64)
            sums = np.add.reduceat(rows, (np.cumsum(counts) - counts)[some])
            out[some] = -sums[:, :size] / sums[:, size:]
        return out


class RunCounts:
    """Runs of letters met so far, and how often in each language."""

    def __init__(self):
        self.keys, self.runs = common.Keys(), []
        self.times: dict[str, np.ndarray] = {}

    def add(self, texts: list[str], langs: list[str]) -> None:
        joined, starts, lengths, hashes, counts = common.letter_runs([t.lower() for t in texts], marks=True)
        at, new = self.keys.number(hashes)
        self.runs += [joined[i : i + n] for i, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)]
        names = sorted(set(langs))
        of = np.repeat([names.index(x) for x in langs], counts)
        for i, name in enumerate(names):
            more = np.bincount(at[of == i], minlength=len(self.runs))
            have = self.times.get(name)
            if have is not None:
                more[: len(have)] += have
            self.times[name] = more

    def counted(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(language, keys, counts) of the longest n-grams."""
        for name, times in self.times.items():
            yield name, *count_keys({self.runs[i]: int(times[i]) for i in np.flatnonzero(times).tolist()})


def groups_of(sizes: dict[str, int]) -> list[list[str]]:
    """Languages, in order of their names, in groups of at most MODEL_KEYS keys and MODEL_CELLS numbers; a larger one stands alone."""
    groups: list[list[str]] = []
    held = 0
    for name in sorted(sizes):
        held += sizes[name]
        if not groups or held > MODEL_KEYS or held * (len(groups[-1]) + 1) > MODEL_CELLS:
            groups.append([])
            held = sizes[name]
        groups[-1].append(name)
    return groups


def learn_counts(docs: DataFrame, text: str, lang: str) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Counts of n-gram keys per language over all rows of docs, one group of languages after the other."""
    n_buckets = common.bucket_count(common.input_bytes(docs), 16 << 20, least=16, most=4096)

    def packed(held: RunCounts) -> Iterator[pa.RecordBatch]:
        for name, keys, times in held.counted():
            bucket = (common.fmix(keys) >> U64(32)) * U64(n_buckets) >> U64(32)
            rows = [(name, b, k.tobytes(), t.tobytes()) for b, (k, t) in common.packed(bucket.astype(np.int64), n_buckets, [keys, times])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["lang", "bucket", "keys", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = RunCounts()
        for table in common.chunks(batches):
            held.add(common.decoded(table.column("text").to_pylist()), table.column("lang").to_pylist())
            if len(held.runs) > CACHE_RUNS:
                yield from packed(held)
                held = RunCounts()
        yield from packed(held)

    def add(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = common.eased(part)
        keys, times = add_up(common.gather(part.column("keys").to_pylist(), U64), common.gather(part.column("times").to_pylist(), np.int64))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "keys": pa.array([keys.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    source = docs.where(common.quoted(lang).isNotNull()).select(common.binary(text).alias("text"), common.quoted(lang).alias("lang"))
    summed = common.table(source.mapInArrow(run, "lang string, bucket int, keys binary, times binary").groupBy("lang", "bucket").applyInArrow(add, "lang string, keys binary, times binary, n long"), "ngrams")
    sizes = {r.lang: r.n for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    for group in groups_of(sizes):
        out: dict[str, list] = {}
        for r in summed.where(F.col("lang").isin(group)).select("lang", "keys", "times").toLocalIterator():  # the keys of one group
            out.setdefault(r.lang, []).append((np.frombuffer(r["keys"], U64), np.frombuffer(r["times"], np.int64)))
        yield {name: add_up(np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts])) for name, parts in out.items()}


TEMPERATURES = np.geomspace(0.01, 2.0, 40)


class Calibration:
    """What temperature and limits need of learning rows: each temperature's loss, and number, mean and squared deviations of each language's own entropies. Sums of parts add up."""

    def __init__(self, size: int):
        self.loss = np.zeros(len(TEMPERATURES))
        self.n, self.mean, self.square = np.zeros((3, size))

    def add(self, entropies: np.ndarray, right: np.ndarray) -> None:
        if not len(right):
            return
        rows = np.arange(len(right))
        lowest = entropies.min(1, keepdims=True)
        for i, t in enumerate(TEMPERATURES):
            z = (lowest - entropies) / t
            self.loss[i] += float(np.sum(np.log(np.exp(z).sum(1)) - z[rows, right]))
        size, own = len(self.n), entropies[rows, right]
        n = np.bincount(right, minlength=size).astype(float)
        mean = np.bincount(right, own, size) / np.maximum(n, 1)
        self._join(n, mean, np.bincount(right, (own - mean[right]) ** 2, size))

    def _join(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray) -> None:
        both, apart = np.maximum(self.n + n, 1), mean - self.mean
        self.square += square + apart**2 * self.n * n / both
        self.mean = self.mean + apart * n / both
        self.n = self.n + n

    def packed(self) -> bytes:
        return np.concatenate([self.loss, self.n, self.mean, self.square]).tobytes()

    def add_packed(self, data: bytes) -> None:
        loss, rest = np.split(np.frombuffer(data, float), [len(TEMPERATURES)])
        self.loss = self.loss + loss
        self._join(*rest.reshape(3, -1))

    def result(self) -> tuple[float, np.ndarray]:
        """Temperature that makes the right languages likeliest, and each language's limit on the best entropy."""
        if not self.n.sum():
            return 0.1, np.full(len(self.n), np.inf)
        limits = self.mean + 6 * np.sqrt(self.square / np.maximum(self.n, 1)) + 0.3
        return float(TEMPERATURES[self.loss.argmin()]), np.where(self.n > 0, limits, np.inf)


def identify(docs: DataFrame, learn: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected; learned from the rows of `learn`. Columns of these names are replaced."""
    spark = common.tune(docs.sparkSession)
    langs: list[str] = []
    shared = []
    for counts in learn_counts(learn, text, lang):
        model = Model(counts)
        langs += model.langs
        shared.append(spark.sparkContext.broadcast(model))
    if not langs:
        kept = [common.quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "cross_entropy", "rejected") and (keep_text or c != text)]
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    fit = learn.where(common.quoted(lang).isNotNull()).select(common.binary(text).alias("text"), common.quoted(lang).alias("lang"))
    size, place_of = len(langs), {name: i for i, name in enumerate(langs)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, sums = Scorer(shared, size), Calibration(size)
        for table in common.chunks(batches):
            h = scorer.entropies(common.decoded(table.column("text").to_pylist()))
            right = np.array([place_of.get(x, -1) for x in table.column("lang").to_pylist()], np.int64)
            known = np.isfinite(h[:, 0]) & (right >= 0)
            sums.add(h[known], right[known])
        yield pa.RecordBatch.from_arrays([pa.array([sums.packed()], pa.binary())], names=["sums"])

    sums = Calibration(size)
    for r in fit.mapInArrow(measure, "sums binary").collect():  # a row of a few hundred numbers for each partition
        sums.add_packed(r["sums"])
    temperature, limits = sums.result()

    def start():
        scorer = Scorer(shared, size)
        names = np.array([*langs, "und"], object)

        def make(texts: list[bytes | None]) -> list[pa.Array]:
            h = scorer.entropies(common.decoded(texts))
            known = np.isfinite(h[:, 0])
            best = np.where(known, h.argmin(1), size)
            lowest = np.where(known, h.min(1), 0.0)
            z = np.where(known[:, None], np.exp(-(np.where(known[:, None], h, 0.0) - lowest[:, None]) / temperature), 0.0)
            score = np.where(known, 1.0 / np.maximum(z.sum(1), 1.0), 0.0)
            rejected = ~known | (lowest > np.append(limits, np.inf)[best])
            return [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(lowest, mask=~known), pa.array(rejected)]

        return make

    return common.added_columns(docs, text, "lang_pred string, score double, cross_entropy double, rejected boolean", start, keep_text)


def fold(column: str, parts: int):
    """crc32 of an id's digits, modulo parts; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def query(spark, sf_dir: str) -> DataFrame:
    """op3: language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.where(fold("doc_id", 3) != 1)
    narrow = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return identify(narrow, learn, keep_text=False).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
