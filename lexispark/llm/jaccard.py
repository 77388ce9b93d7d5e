"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles. A parity sketch gives every shingle one bit and flips it, so that the
Hamming distance of two sketches is at most the size of the sets' symmetric difference, which a Jaccard similarity of
0.8 bounds by (|A| + |B|) / 9. Sketches of one band of sizes are cut into more blocks than that bound: two documents
that link agree on some blocks (pigeonhole), so equal blocks are the join keys. Sketches are wide (2^16 bits a block)
and kept sparse: a block's key is the XOR of a mixed value for each odd bit.

Nothing is lost, for these reasons:
 * a pair differs in at most d blocks and a band has K > d of them, so K - d blocks at least agree;
 * agreeing blocks may be empty, or hot (shared by more than HOT documents). A document whose empty and hot blocks are
   fewer than K - d has a block of another kind in common with every partner, so its hot blocks need no pairs;
 * the others (mostly groups of near copies, whose blocks are all hot) first meet the least document of each hot block;
   what hot blocks connect is a cluster, and documents of a cluster that are in different components after that are
   compared by their dense sketches, tile by tile: tiles hold documents of a like size and a bounded number of them. Each
   document is verified twice against the nearest of another component, then against all that sketches still let through;
 * documents with too many empty blocks (tiny ones) also send the prefix of their shingles in hash order.
A candidate pair first compares dense sketches (some two bits a shingle): a Hamming distance beyond the bound excludes
it. What is left is verified on whole sets with integers: each document against the least partner it has, then pairs
whose documents are still in different components. Documents with equal sets are one class before any of this.

Scale: a batch of documents sends its keys packed in one row per bucket, keys of equal sets in a batch are sent once,
and only documents in some pair that the sketches let through are read again. Such a document's set is sent to the task
of each partner it meets; partners of one document are dealt over as many tasks as there are dozens of them.

Defined results: null, empty and word-free texts have no shingles and link with nothing; fewer than 5 words are one
shingle; repeated rows are all kept; a null id is grouped by its text; columns of the input with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.common import U64, fmix
from lexispark.llm.components import components

#: Documents of one block up to which all its pairs are candidates.
HOT = 8
#: Bytes of packed keys that a bucket should have, as seen from the input's size.
BUCKET_BYTES = 6 << 20
BAND = 1.5625  # sizes of a band differ by no more than the square of 1 / 0.8
MASK32 = U64(0xFFFFFFFF)


def band_edges(most: int = 1 << 40) -> np.ndarray:
    """Least sizes of the bands."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, np.int64)


EDGES = band_edges()
#: Per band: the bound d on differing blocks for pairs whose smaller set is in the band, and the number of blocks.
BOUND = (EDGES[1:] - 1) // 4
BLOCKS = BOUND + 1 + (3 * (BOUND + 1) + 9) // 10 + 2


def shingle_sets(texts: list[bytes | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = common.split_words(texts, fold=True)
    hashes = common.word_hashes(words)
    rolled = common.poly(hashes, n)
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        start = end - count
        if count >= n:
            out.append(np.unique(rolled[start : end - n + 1]))
        elif count:
            out.append(fmix(common.poly(hashes[start:end], count)[:1] + U64(count)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_hash(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, without regard to order."""
    signed = lambda x: int(np.int64(np.uint64(x)))
    if not len(own):
        return 0, 0
    return signed(fmix(fmix(own ^ U64(0x5851F42D4C957F2D)).sum(keepdims=True))[0]), signed(fmix(own + U64(0x14057B7EF767814F)).sum(keepdims=True)[0])


def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of non-empty sets, each in one or two bands: (set number and margin of each set and band, number of set and band and key of each key). margin: hot keys that a document can have while some other block must still agree."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    own_band = np.searchsorted(EDGES, size, side="right") - 1
    lower = np.flatnonzero((own_band > 0) & (size * 4 <= (EDGES[own_band] - 1) * 5))  # may be the larger of a pair whose smaller is a band below
    which = np.concatenate([np.arange(len(sets)), lower])
    band = np.concatenate([own_band, own_band[lower] - 1])
    blocks = BLOCKS[band]
    first = np.cumsum(blocks) - blocks
    elements = np.concatenate([sets[i] for i in which]) if len(which) else np.zeros(0, U64)
    of = np.repeat(np.arange(len(which)), size[which])
    salted = fmix(elements ^ fmix((band[of].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)))
    slot = first[of] + ((salted >> U64(32)) * blocks[of].astype(U64) >> U64(32)).astype(np.int64)
    bits = np.sort(slot.astype(U64) << U64(16) | (salted & U64(0xFFFF)))
    at, times = common.runs(bits)
    odd = bits[at][times % 2 == 1]  # the bits that are set in the sketches
    slots = (odd >> U64(16)).astype(np.int64)
    start, _ = common.runs(slots)
    filled = slots[start]
    sketch = np.bitwise_xor.reduceat(fmix(odd & U64(0xFFFF) | U64(1 << 20)), start) if len(start) else np.zeros(0, U64)
    doc = np.searchsorted(first, filled, side="right") - 1
    keys = fmix(sketch ^ fmix((filled - first[doc]).astype(U64) << U64(20) | band[doc].astype(U64)))
    margin = np.bincount(doc, minlength=len(which)) - BOUND[band]  # K - d - empty
    weak = np.flatnonzero(margin <= 0)
    more_doc, more_key = [doc], [keys]
    for i in weak.tolist():
        own = sets[which[i]]
        prefix = len(own) - -(-4 * len(own) // 5) + 1
        more_key.append(fmix(own[:prefix] ^ fmix(np.array([int(band[i]) + (1 << 40)], U64))))
        more_doc.append(np.full(prefix, i))
    return which, margin, np.concatenate(more_doc), np.concatenate(more_key)


def dense_sketch(own: np.ndarray) -> bytes:
    """Parity sketch of two to four bits a shingle."""
    bits = max(64, 1 << int(2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketches_allow(a: bytes, b: bytes, size_a: int, size_b: int, percent: int = 80) -> bool:
    """False only if the sketches' distance shows that the sets can't link. The longer sketch is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * (size_a + size_b)


def _scan(docs: DataFrame, n: int, n_buckets: int, text: str, doc_id: str) -> DataFrame:
    """kind 0: a document's id, set size and set hash; kind 1: packed keys of a batch for a bucket."""
    schema = "kind int, doc_id long, n long, h1 long, h2 long, sketch binary, bucket int, sets binary, counts binary, keys binary, margins binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches):
            sets = shingle_sets(table.column("text").to_pylist(), n)
            hashes = [set_hash(s) for s in sets]
            count = len(sets)
            ids = table.column("doc_id").to_pylist()
            rows = {"kind": [0] * count, "doc_id": ids, "n": [len(s) for s in sets], "h1": [h[0] for h in hashes], "h2": [h[1] for h in hashes], "sketch": [dense_sketch(s) for s in sets], "bucket": [None] * count, "sets": [None] * count, "counts": [None] * count, "keys": [None] * count, "margins": [None] * count}
            once = {h: i for i, h in enumerate(hashes) if len(sets[i])}  # equal sets of a batch send their keys once
            some = list(once.values())
            if some:
                which, margin, of, keys = keys_of([sets[i] for i in some])
                h1, margin = np.array([hashes[i][0] for i in some], np.int64)[which], np.clip(margin, -1, 32000).astype(np.int16)
                bucket = (keys >> U64(32)) * U64(n_buckets) >> U64(32)
                for b, (w, k) in common.packed(bucket.astype(np.int64), n_buckets, [of, keys.astype(np.uint32)]):
                    order = np.argsort(w, kind="stable")
                    w = w[order]
                    start, times = common.runs(w)
                    for name, value in (("kind", 1), ("doc_id", None), ("n", None), ("h1", None), ("h2", None), ("sketch", None), ("bucket", b), ("sets", h1[w[start]].tobytes()), ("counts", times.astype(np.int32).tobytes()), ("keys", k[order].tobytes()), ("margins", margin[w[start]].tobytes())):
                        rows[name].append(value)
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(rows[x], t) for x, t in zip(names, kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.binary(text).alias("text")).mapInArrow(run, schema)


def _match(bucket: pa.Table) -> pa.Table:
    """Of one bucket, kind 0: pairs (a < b) of blocks that few share; kind 1: entries (key, a) of hot blocks with their margins."""
    bucket = common.eased(bucket)
    sets = common.gather(bucket.column("sets").to_pylist(), np.int64)
    counts = common.gather(bucket.column("counts").to_pylist(), np.int32)
    keys = common.gather(bucket.column("keys").to_pylist(), np.uint32).astype(U64) | U64(bucket.column("bucket")[0].as_py() << 32)
    margins = np.repeat(common.gather(bucket.column("margins").to_pylist(), np.int16), counts)
    own = np.repeat(sets, counts)
    order = np.lexsort((own, keys))
    keys, own, margins = keys[order], own[order], margins[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    keys, own, margins = keys[fresh], own[fresh], margins[fresh]
    start, times = common.runs(keys)
    pairs = []
    for size in range(2, HOT + 1):
        at = start[times == size]
        for i in range(size):
            for j in range(i + 1, size):
                pairs.append(np.stack([own[at + i], own[at + j]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    hot = np.repeat(times > HOT, times)
    n, m = len(pairs), int(hot.sum())
    return pa.table(
        {
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])),
            "a": pa.array(np.concatenate([pairs[:, 0], own[hot]])),
            "b": pa.array(np.concatenate([pairs[:, 1], keys[hot].view(np.int64)])),
            "margin": pa.array(np.concatenate([np.zeros(n, np.int32), margins[hot].astype(np.int32)])),
        }
    )


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a < b) of set hashes whose sketches allow a link."""
    own = classes.where("rep is not null").select(F.col("h1").alias("h"), "n", "sketch")
    left = own.select(F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = own.select(F.col("h").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b")), strict=True)) if sketches_allow(*row)]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").where("5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long").distinct()


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, size, sketch, component) of all classes."""
    reps = classes.where("rep is not null").select(F.col("h1").alias("h"), F.col("n").alias("size"), "sketch", "rep")
    return reps.join(labels, F.col("rep") == F.col("node"), "left").select("h", "size", "sketch", F.coalesce("component", "rep").alias("component"))


#: Documents of a tile, about, and the ratio of sizes that a tile spans. Five steps of it exceed 1 / 0.8.
TILE, TILE_RATIO, TILE_STEPS = 1024, 1.05, 5


def _within_clusters(clusters: DataFrame, named: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a < b) of a cluster in different components that sizes and sketches allow; with nearest, of each document and tile only the closest."""
    members = clusters.join(named, "h").withColumn("step", F.floor(F.log(TILE_RATIO, F.col("size"))).cast("int"))
    open_ = members.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("cluster")
    members = common.table(members.join(open_, "cluster", "left_semi"), "members")
    rows = members.groupBy("cluster", "step").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    members = members.join(rows, ["cluster", "step"]).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    tiles = rows.select("cluster", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = tiles.select("cluster", F.struct("step", "part").alias("first"))
    second = tiles.select("cluster", F.struct("step", "part").alias("second"))
    both = first.join(second, "cluster").where(f"first <= second and second.step - first.step <= {TILE_STEPS}")
    stops = both.select("cluster", "first", "second", F.explode(F.when(F.expr("first = second"), F.array("first")).otherwise(F.array("first", "second"))).alias("own"))
    stops = stops.select("cluster", "first", "second", F.col("own.step").alias("step"), F.col("own.part").alias("part"))
    sent = stops.join(members, ["cluster", "step", "part"]).select("cluster", "first", "second", F.expr("first.step = step and first.part = part").alias("left"), "h", "size", "sketch", "component")

    def compare(group: pa.Table) -> pa.Table:
        group = common.eased(group)
        left = group.column("left").to_numpy(zero_copy_only=False)
        h, size, component = (group.column(c).to_numpy() for c in ("h", "size", "component"))
        raw = [np.frombuffer(x, np.uint64) for x in group.column("sketch").to_pylist()]
        least = min(map(len, raw))
        sketch = np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), 0) for x in raw])
        same = bool((group.column("first")[0].as_py()) == (group.column("second")[0].as_py()))
        rows = np.flatnonzero(left)
        columns = rows if same else np.flatnonzero(~left)
        out, closest = [], np.full(len(columns), 1 << 40)
        partner = np.full(len(columns), -1)
        for k, i in enumerate(rows.tolist()):
            distance = np.bitwise_count(sketch[columns] ^ sketch[i]).sum(1, dtype=np.int64)
            fine = (180 * distance <= 20 * (size[columns] + size[i])) & (component[columns] != component[i]) & (5 * size[columns] >= 4 * size[i]) & (5 * size[i] >= 4 * size[columns])
            if same:
                fine[: k + 1] = False
            at = np.flatnonzero(fine)
            if len(at) and nearest:
                out.append((h[i], h[columns[at[distance[at].argmin()]]]))
                near = at[distance[at] < closest[at]]
                closest[near], partner[near] = distance[near], i
            elif len(at):
                out += [(h[i], y) for y in h[columns[at]]]
        out += [(h[p], h[c]) for p, c in zip(partner.tolist(), columns.tolist(), strict=True) if p >= 0]
        pairs = np.unique(np.sort(np.array(out, np.int64).reshape(-1, 2), 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return sent.groupBy("cluster", "first", "second").applyInArrow(compare, "a long, b long")


#: Partners of a document that one task compares with it, stops of one row, and bytes of sets that are sent at once.
PARTNERS, STOPS, SENT_BYTES = 48, 64, 4 << 20


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, text: str, doc_id: str, percent: int = 80) -> DataFrame:
    """Links (a, b) of representatives among pairs of set hashes. Documents are read again, and each set goes to the tasks of its pairs."""
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("tasks"))
    dealt = common.table(pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("part")), "dealt")
    stops = dealt.select(F.col("b").alias("h"), "a", "part").unionByName(dealt.select(F.col("a").alias("h"), "a", "part").distinct())
    reps = classes.where("rep is not null").select(F.col("h1").alias("h"), "rep")
    slot = F.when(F.col("a") == F.col("h"), F.floor(F.col("part") / STOPS)).otherwise(-1).alias("slot")  # a hub's stops are many rows
    routes = stops.join(reps, "h").groupBy("h", "rep", slot).agg(F.collect_list(F.struct("a", "part")).alias("stops")).drop("slot")
    routes = common.sized(common.table(routes, "routes"))
    source = docs.select(common.quoted(doc_id).cast("long").alias("doc_id"), common.binary(text).alias("text"))

    def sent_rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "part", "h", "rep", "shingles"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches):
            out, held = [[], [], [], [], []], 0
            for own, h, rep, stops in zip(shingle_sets(table.column("text").to_pylist(), n), *(table.column(c).to_pylist() for c in ("h", "rep", "stops")), strict=True):
                if set_hash(own)[0] == h:
                    data = own.tobytes()
                    for stop in stops:
                        for column, value in zip(out, (stop["a"], stop["part"], h, rep, data), strict=True):
                            column.append(value)
                        held += len(data)
                        if held > SENT_BYTES:
                            yield sent_rows(out)
                            out, held = [[], [], [], [], []], 0
            yield sent_rows(out)

    def compare(group: pa.Table) -> pa.Table:
        group = common.eased(group)
        leader = group.column("a")[0].as_py()
        hs, reps_, sets = (group.column(c).to_pylist() for c in ("h", "rep", "shingles"))
        links = []
        for i in [i for i, h in enumerate(hs) if h == leader]:
            mine = np.frombuffer(sets[i], U64)
            for h, rep, data in zip(hs, reps_, sets, strict=True):
                other = np.frombuffer(data, U64)
                if h == leader or 100 * min(len(mine), len(other)) < percent * max(len(mine), len(other)):
                    continue
                both = np.sort(np.concatenate([mine, other]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(mine) + len(other) - shared):
                    links.append((reps_[i], rep))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    sent = source.join(routes, source.doc_id == routes.rep).select("text", "h", "rep", "stops").mapInArrow(send, "a long, part int, h long, rep long, shingles binary")
    return common.table(sent.groupBy("a", "part").applyInArrow(compare, "a long, b long").distinct(), "links")


def jaccard_join(docs: DataFrame, n: int = 5, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Links of class representatives (a, b) that span every component, and every row's (doc_id, n_shingles, rep, component_id)."""
    spark = common.tune(docs.sparkSession)
    n_buckets = common.bucket_count(common.input_bytes(docs), BUCKET_BYTES)
    scan = common.table(_scan(docs, n, n_buckets, text, doc_id), "sketches")
    rows = scan.where("kind = 0").select("doc_id", "n", "h1", "h2", "sketch")
    classes = common.table(rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    packed = scan.where("kind = 1").select("bucket", "sets", "counts", "keys", "margins")
    found = common.table(packed.groupBy("bucket").applyInArrow(_match, "kind int, a long, b long, margin int"), "candidates")
    cold = found.where("kind = 0").select("a", "b").distinct()

    # Hot blocks: only of documents that have no other block to rely on.
    hot = found.where("kind = 1").select(F.col("b").alias("key"), F.col("a").alias("h"), "margin")
    risky = hot.groupBy("h", "margin").agg(F.count("*").alias("n_hot")).where("n_hot >= margin").select("h", "margin")
    hot = common.table(hot.join(risky, ["h", "margin"], "left_semi").select("key", "h").distinct(), "hot")
    least = hot.groupBy("key").agg(F.min("h").alias("a"))
    star = hot.join(least, "key").where("a <> h").select("a", F.col("h").alias("b")).distinct()
    pairs = common.table(_sketched(cold.unionByName(star).distinct(), classes), "pairs")

    forest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verify(forest, classes, docs, n, text, doc_id)
    labels = components(links)

    # Pairs whose documents are in different components after that; of clusters of hot blocks, twice the nearest, then all.
    clusters = common.table(components(star).select(F.col("node").alias("h"), F.col("component").alias("cluster")), "clusters")
    done = forest
    for nearest in (True, True, False):
        named = _named(classes, labels)
        more = _within_clusters(clusters, named, nearest)
        if not nearest:
            left = named.select(F.col("h").alias("a"), F.col("component").alias("c_a"))
            right = named.select(F.col("h").alias("b"), F.col("component").alias("c_b"))
            more = more.unionByName(pairs.join(left, "a").join(right, "b").where("c_a <> c_b").select("a", "b"))
        more = common.table(more.distinct().join(done, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            links = common.table(links.unionByName(_verify(more, classes, docs, n, text, doc_id)), "links")
            labels = components(links)
            done = done.unionByName(more)

    final = classes.join(labels, classes.rep == labels.node, "left").select("n", "h1", "h2", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.drop("sketch").join(final, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("component", "doc_id").alias("component_id"))
    return links, out


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's set size and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs)[1].select("doc_id", "n_shingles", "component_id")
