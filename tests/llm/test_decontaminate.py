"""Retrieval of verbatim and reworded items, and clean documents left alone."""

import random

import numpy as np

from lexispark.llm import decontaminate as d


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert d.lcs(a, b) == t[-1][-1]


def test_basis_holds_all_items_at_full_rank(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 300, 25)) for _ in range(12)]
    weights = np.ones((1 << d.PLACES_BITS) + 1, np.float32)
    shared = spark.sparkContext.broadcast(weights)
    items = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(3)
    index = d.Index(list(enumerate(texts)), *d.basis_of(items, shared, 20), weights)
    dense = np.zeros((12, 1 << d.PLACES_BITS))
    for i, (at, values) in enumerate(d.sparse_rows([t.encode() for t in texts], weights)):
        dense[i, at] = values
    assert np.allclose(index.sigma, np.linalg.svd(dense, compute_uv=False), atol=1e-3)
    assert np.allclose(index.items @ index.items.T, dense @ dense.T, atol=1e-3)


def test_leaks_and_clean_documents(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "and"] * 60 + [f"word{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join([*draw(22), "end."]) + " " + " ".join(draw(8)) + ".") for i in range(30)] + [(90, "Zip zap zoom"), (91, ""), (92, None), (None, "x y z")]
    rows, want = [], {}
    for k in range(120):
        w = draw(rng.randrange(0, 150))
        if k % 4 == 0:
            own = items[k % 30][1].split()
            if k % 8 == 0:  # reworded: every seventh word is another, one goes
                own = [rng.choice(vocab) if j % 7 == 3 else x.upper() for j, x in enumerate(own)]
                del own[5]
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
            want[k] = [k % 30]
        rows.append((k, " ".join(w), True))
    rows += [(200, "a zip, ZAP zoom b", False), (201, "zip zap and zoom", False), (202, None, False), (203, "", False), (204, "... !!", False), (None, items[3][1], False)]
    want |= {200: [90], None: [3]}
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in d.decontaminate(docs, bench).collect()}
    assert len(got) == len(rows)
    assert {k: list(r.leaked_items) for k, r in got.items() if r.contaminated} == want
    assert all(r.leak_share == 0 for k, r in got.items() if k not in want)
    assert not any(r.contaminated for r in d.decontaminate(docs, bench.limit(0)).collect())
    assert d.decontaminate(docs.limit(0), bench).count() == 0


def test_item_blocks_find_the_same(spark, monkeypatch):
    texts = [" ".join(f"b{i}x{j}" for j in range(12)) for i in range(9)]
    docs = spark.createDataFrame([(i, f"q r s {t} u v") for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    monkeypatch.setattr(d, "ITEM_BLOCK", 4)
    assert {(r.doc_id, *r.leaked_items) for r in d.decontaminate(docs, bench).collect()} == {(i, i) for i in range(9)}


def test_copies_from_a_benchmark_of_thousands(spark):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randrange(15, 60)))) for i in range(2000)]
    rows = []
    for k in range(200):  # every second one reworded: each seventh word is another
        own = [f"new{j}" if k % 2 and j % 7 == 3 else x for j, x in enumerate(items[k * 10][1].split())]
        rows.append((k, " ".join([*draw(40), *own, *draw(40)])))
    docs = spark.createDataFrame([*rows, *((200 + i, " ".join(draw(100))) for i in range(300))], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, *r.leaked_items) for r in d.decontaminate(docs, bench).collect() if r.contaminated} == {(k, k * 10) for k in range(200)}


def test_copies_of_long_and_short_items(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    sizes = [rng.randrange(250, 390) for _ in range(60)] + [rng.randrange(2, 12) for _ in range(60)] + [9000]
    items = [(i, " ".join(draw(n))) for i, n in enumerate(sizes)] + [(900, "sole"), (901, "... !")]
    rows, want = [], set()
    for k, n in enumerate(sizes):  # long ones also reworded: each seventh word is another
        own = [f"new{j}" if n > 99 and k % 2 and j % 7 == 3 else x for j, x in enumerate(items[k][1].split())]
        rows.append((k, " ".join([*draw(40), *own, *draw(40)])))
        want.add((k, k))
    rows += [(500, "so sole, so"), (501, "solely"), *((502 + i, " ".join(draw(100))) for i in range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, *r.leaked_items) for r in d.decontaminate(docs, bench).collect() if r.contaminated} == want | {(500, 900)}
