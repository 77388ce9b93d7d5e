"""Embedding near-dedup by product quantisation.

Equal vectors of a label are one class. Unit vectors get a coarse cell and, for the residual, one code per subspace;
the length of what the codes leave out is kept beside them. A query visits every cell in which, by the half-space
between two centroids, a vector within reach can lie; there, a table of partial distances gives the asymmetric distance
to each code, and items within reach plus their own coding error are candidates. Both tests are exact bounds, so probes
and tables lose nothing (a slack covers rounding), and candidates are ranked by cosine in double precision.

Scale: cells grow with the data (up to MAX_CELLS, each for some CELL vectors of a label) and are fitted, like the
codebooks, on SAMPLE vectors or CELL_SAMPLE for each cell; every vector is indexed and searched. Beyond MAX_CELLS cells get
fuller and time grows faster than the data, memory does not: items of a label and cell are dealt to blocks of BLOCK, and
distances to cells are taken for SLICE vectors at a time. A query meets its own cell and those after it, so a pair meets once. A block answers with each vector's number of links and a forest that connects
what is linked in it, never with the pairs themselves; copies are never expanded.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without label, link with
nothing; vectors of different length do not link; rows with equal ids are kept, and link as if ids differed (a class is
known by a hash of label and vector, not by an id); rows without an id link with nothing and have no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.components import components

LEAST_COSINE = 0.93
SAMPLE = 8000
MAX_CELLS = 4096
CELL_SAMPLE = 8
#: Vectors that a cell of one label should hold, and those of one block.
CELL, BLOCK = 4000, 2048
SUBSPACE = 4
CODES = 64
SLACK = 1e-4
#: Vectors whose distances to all cells are held at once.
SLICE = 1024


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids; distinct starts, empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for i in range(0, len(points), 4096):
        part = points[i : i + 4096]
        out[i : i + 4096] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
    return out


class Quantiser:
    """Coarse cells and residual codes for vectors of one length (shorter ones are padded with zeros)."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.size = -(-sample.shape[1] // SUBSPACE) * SUBSPACE
        sample = self.pad(sample)
        self.cells = kmeans(sample, cells)
        rest = sample - self.cells[nearest(sample, self.cells)]
        self.books = [kmeans(rest[:, i : i + SUBSPACE], CODES, seed=5 + i) for i in range(0, self.size, SUBSPACE)]

    def pad(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), self.size), np.float32)
        out[:, : points.shape[1]] = points
        return out

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error): error is the distance from a point to what its cell and codes say."""
        points = self.pad(points)
        cell = nearest(points, self.cells)
        rest = points - self.cells[cell]
        codes = np.stack([nearest(rest[:, i * SUBSPACE : (i + 1) * SUBSPACE], b) for i, b in enumerate(self.books)], 1)
        said = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return cell, codes.astype(np.uint8), np.linalg.norm(rest - said, axis=1)

    def probes(self, points: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """True for (point, cell) if a vector of that cell can lie within reach of the point."""
        points, length = self.pad(points), (self.cells.astype(np.float64) ** 2).sum(1)
        out = np.empty((len(points), len(self.cells)), bool)
        for i in range(0, len(points), SLICE):
            part, mine = points[i : i + SLICE].astype(np.float64), own[i : i + SLICE]
            farther = length - 2 * part @ self.cells.T  # squared distances, less what all cells share
            farther -= farther[np.arange(len(part)), mine][:, None]
            used, which = np.unique(mine, return_inverse=True)
            apart = np.sqrt(np.maximum(length[used][:, None] + length - 2 * self.cells[used].astype(np.float64) @ self.cells.T, 1e-12))
            out[i : i + SLICE] = farther <= 2 * (reach + SLACK) * apart[which]
        return out

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of one query to the items of a cell, by table look-up."""
        rest = self.pad(query[None])[0] - self.cells[cell]
        total = np.zeros(len(codes))
        for i, book in enumerate(self.books):
            table = ((rest[i * SUBSPACE : (i + 1) * SUBSPACE] - book) ** 2).sum(1)
            total += table[codes[:, i]]
        return np.sqrt(total)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 1))


def classes_of(df: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with the key of its class (null if it links with nothing), and classes with a node (a hash of label and vector), least id, size and vector."""
    schema = "row_id long, label long, vector binary, size int"

    def clean(batches):
        for batch in batches:
            blobs, sizes = [], []
            for v in batch.column("v").to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    x = x if np.isfinite(x).all() and x.any() else None
                blobs.append(None if x is None else x.tobytes())
                sizes.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label"), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int32())], names=["row_id", "label", "vector", "size"])

    source = df.select(common.quoted(vec_id).cast("long").alias("row_id"), common.quoted(label).cast("long").alias("label"), common.quoted(embedding).cast("array<double>").alias("v"))
    rows = source.mapInArrow(clean, schema).withColumn("key", F.when(F.col("label").isNotNull() & F.col("row_id").isNotNull(), F.sha2(F.col("vector"), 256)))
    rows = common.table(rows, "rows")
    classes = rows.where("key is not null").groupBy("label", "key").agg(F.min("row_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("size").alias("size")).withColumn("node", F.xxhash64("label", "key"))
    return rows.select("row_id", "label", "key"), common.table(classes, "vectors")


def links_of(classes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Of classes' nodes, kind 0: a with the number n of other vectors linked to it in a block; kind 1: edges (a, b) that connect what a block's links connect."""
    spark = classes.sparkSession
    links = None
    sizes = [r["size"] for r in classes.select("size").distinct().collect()]  # lengths of vectors: a few
    reach = float(np.sqrt(2 - 2 * least))
    for size in sizes:
        own = classes.where(F.col("size") == size)
        total, labels = own.agg(F.count("*"), F.countDistinct("label")).first()
        cells = int(min(MAX_CELLS, max(4, total // (labels * CELL))))
        rows = max(SAMPLE, CELL_SAMPLE * cells)
        share = min(1.0, 1.3 * rows / total)
        drawn = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows).select("vector").collect()
        sample = np.stack([np.frombuffer(r.vector, np.float64) for r in drawn])
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(Quantiser(sample.astype(np.float32), cells))

        def index(batches):
            q = shared.value
            for table in common.chunks(batches, "vector"):
                x = _matrix(table.column("vector"))
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                cell, codes, error = q.encode(unit)
                probe = q.probes(unit, cell, reach)
                probe[np.arange(len(cell)), cell] = True
                after = [np.flatnonzero(p[c:]) + c for p, c in zip(probe, cell.tolist(), strict=True)]  # the other way, the other vector is the query
                yield pa.RecordBatch.from_arrays(
                    [table.column("node").combine_chunks(), table.column("copies").combine_chunks(), table.column("label").combine_chunks(), table.column("vector").combine_chunks(), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64)), pa.array([a.astype(np.int32) for a in after], pa.list_(pa.int32()))],
                    names=["node", "copies", "label", "vector", "cell", "codes", "error", "probes"],
                )

        indexed = common.table(own.select("node", "copies", "label", "vector").mapInArrow(index, "node long, copies long, label long, vector binary, cell int, codes binary, error double, probes array<int>"), "index")
        counts = indexed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = indexed.join(counts, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        items = placed.select("label", "cell", "block", F.lit(False).alias("asks"), "node", "copies", "vector", "codes", "error", F.col("cell").alias("home"))
        asked = indexed.select("label", F.explode("probes").alias("cell"), "node", "copies", "vector", "codes", "error", F.col("cell").alias("home")).join(counts, ["label", "cell"])
        asked = asked.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "node", "copies", "vector", "codes", "error", "home")

        def search(group: pa.Table) -> pa.Table:
            group, q = common.eased(group), shared.value
            asks = group.column("asks").to_numpy(zero_copy_only=False)
            cell = group.column("cell")[0].as_py()
            node, copies, home, error = (group.column(c).to_numpy() for c in ("node", "copies", "home", "error"))
            x = _matrix(group.column("vector"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint8).reshape(len(node), -1)
            item = np.flatnonzero(~asks)
            names, local = np.unique(node, return_inverse=True)
            degree, up = np.zeros(len(names), np.int64), list(range(len(names)))

            def top(v: int) -> int:
                while up[v] != v:
                    up[v] = v = up[up[v]]
                return v

            bound = reach + SLACK + error[item]
            for i in np.flatnonzero(asks).tolist():
                close = item[q.distances(x[i].astype(np.float32), cell, codes[item]) <= bound]
                if home[i] == cell:
                    close = close[node[close] > node[i]]
                if len(close):
                    close = close[x[close] @ x[i] >= least - 1e-9]
                    close = close[[float(np.dot(x[j], x[i])) >= least for j in close]] if len(close) else close
                if len(close):
                    degree[local[i]] += copies[close].sum()
                    degree[local[close]] += copies[i]
                    for j in local[close].tolist():
                        u, v = sorted((top(int(local[i])), top(j)))
                        up[v] = u
            some = np.flatnonzero(degree)
            low = np.array([v for v in range(len(up)) if up[v] != v], np.int64)
            roots = np.array([top(v) for v in low.tolist()], np.int64)
            return pa.table(
                {
                    "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(some), len(low)])),
                    "a": pa.array(np.concatenate([names[some], names[roots]]).astype(np.int64)),
                    "b": pa.array(np.concatenate([names[some], names[low]]).astype(np.int64)),
                    "n": pa.array(np.concatenate([degree[some], np.zeros(len(low), np.int64)])),
                }
            )

        found = common.table(items.unionByName(asked).groupBy("label", "cell", "block").applyInArrow(search, "kind int, a long, b long, n long"), "near")
        links = found if links is None else links.unionByName(found)
    return links if links is not None else spark.createDataFrame([], "kind int, a long, b long, n long")


def near_dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df."""
    common.tune(df.sparkSession)
    rows, classes = classes_of(df, vec_id, embedding, label)
    found = links_of(classes, least)
    degrees = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    linked = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("component", "group")
    named = common.table(classes.select("node", "rep", "copies", "key", "label").join(degrees, "node", "left").join(linked, "node", "left"), "named")
    least = named.where("group is not null").groupBy("group").agg(F.min("rep").alias("least"))
    final = named.join(common.sized(least), "group", "left")
    final = final.select("label", "key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(final, ["label", "key"], "left").select(F.col("row_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "row_id").alias("component_id"))
    return out.withColumn("kept", F.col(vec_id) == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: links, component and keeping of every vector."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")
