"""Product quantisation against all pairs."""

import numpy as np

from lexispark.llm import vectors


def brute(rows, least=0.93):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.array(v, float).any() and g is not None]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x, g) in enumerate(ok):
        for j, y, h in ok[a + 1 :]:
            if g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (links[i], root(i), root(i) == i) for i in links}


def table(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((base + rng.normal(size=12) * rng.choice([0, 0.05, 0.1, 0.25])).tolist())
    rows += [rows[0]] * 30 + [[0.0] * 12, None, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], (np.array(rows[0]) * 2).tolist()]
    order = rng.permutation(len(rows))
    return [(int(k), [float(np.float32(x)) if x is not None else None for x in rows[i]] if rows[i] is not None else None, None if k % 17 == 0 else int(k % 2)) for k, i in enumerate(order)]


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 8)
    monkeypatch.setattr(vectors, "BLOCK", 5)
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_dedup(df).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.01], 0), (3, [1.0, 0.01, 0.0], 0), (1, [1.0, 0.0001, 0.0], 0), (None, [1.0, 0.0, 0.0], 0), (9, [0.0, 0.0, 1.0], None), (9, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 5, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, label int, node long, key string, component double").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_dedup(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (1, 2, 1), (None, 0, None), (9, 0, 9), (9, 2, 1)], key=str)


def test_probes_equal_the_plain_formula_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    points = rng.normal(size=(9000, 64)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    q = vectors.Quantiser(points[:600], 1)
    q.cells = points[:1024]
    own = vectors.nearest(points[:50], q.cells)
    d2 = ((points[:50, None].astype(float) - q.cells[None]) ** 2).sum(2)
    apart = np.sqrt(((q.cells[own][:, None].astype(float) - q.cells[None]) ** 2).sum(2))
    want = (d2 - d2[np.arange(50), own][:, None]) <= 2 * (0.37 + vectors.SLACK) * np.maximum(apart, 1e-6)
    assert np.array_equal(q.probes(points[:50], own, 0.37), want)
    own = vectors.nearest(points[:8192], q.cells)
    tracemalloc.start()
    q.probes(points[:8192], own, 0.37)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_empty_table(spark):
    assert vectors.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
