"""Connected components of an edge table: minimum labels with pointer jumping, on DataFrames; few edges go through one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common


#: Edges up to which one task unites them all (they are counted; 16 bytes each). Beyond, labels travel in rounds.
FEW_EDGES = 400_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            roots = []
            for x in (a, b):
                top = x
                while (above := up.setdefault(top, top)) != top:
                    top = above
                while up[x] != top:
                    up[x], x = top, up[x]
                roots.append(top)
            up[max(roots)] = min(roots)
    tops = []
    for x in up:
        while up[x] != x:
            x = up[x]
        tops.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(tops, pa.int64())], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable.

    Each round gives every node the least label among its neighbours' and its own, then replaces labels by their labels'
    labels, so paths shorten by half at least. Both aggregates combine on the map side; the joins with labels are plain
    equi-joins whose hot keys adaptive execution splits. Labels are written to the shared folder after each round.
    Empty edges give no rows; nulls and self-loops are left out; repeated edges change nothing.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if few:
        clean = common.table(clean, "links")
        if clean.count() <= few:
            return common.table(clean.coalesce(1).mapInArrow(_unite, "node long, component long"), "labels")
    both = common.table(clean.unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("n")).agg(F.min("component").alias("least"))
        step = labels.join(near, labels.node == near.n).select("node", F.least("component", "least").alias("next"), "component")
        step = common.table(step, "step")
        hop = step.select(F.col("node").alias("at"), F.col("next").alias("hop"))
        jumped = step.withColumnRenamed("next", "to_hop").join(hop, F.col("to_hop") == F.col("at"), "left").select("node", F.coalesce("hop", "to_hop").alias("next"), F.col("component").alias("was"))
        labels = common.table(jumped.select("node", F.col("next").alias("component"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            break
        labels = labels.select("node", "component")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", "component")
