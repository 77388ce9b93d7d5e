"""The sketch join against all pairs of a small table."""

import random
import re

import numpy as np

from lexispark.llm import jaccard
from lexispark.llm.components import components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 35, 60, 100, 180, 300]:
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(min(edits, size // 4)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                rows.append(" ".join(w))
    base = [rng.choice(vocab) for _ in range(90)]
    for _ in range(60):  # a large family of near copies: every block is hot
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    for _ in range(60):  # a passage that many share
        rows.append(" ".join([rng.choice(vocab) for _ in range(20)] + passage + [rng.choice(vocab) for _ in range(rng.randrange(1, 25))]))
    rows += ["", "   \t", None, "A b C d E f", "a B c D e F", "x" * 5000, "é É a b c d", "one", "ONE", "a b c d e f g"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_join_equals_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, kind string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df)[1].collect()}
    assert got == brute(rows)


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df)[1].collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 0, None), (5, 0, 5)], key=str)
    assert jaccard.jaccard_join(df.limit(0))[1].count() == 0


def test_sketch_distance_bounds_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[: 60 - int(rng.integers(0, 7))], rng.integers(0, 1 << 63, 4).astype(np.uint64)]))
        difference = len(np.setxor1d(a, b))
        which, _, of, keys = jaccard.keys_of([a, b])
        own = [[set(keys[of == g].tolist()) for g in np.flatnonzero(which == w)] for w in (0, 1)]
        assert min(len(x ^ y) for x in own[0] for y in own[1]) <= 2 * difference
        assert jaccard.sketches_allow(jaccard.dense_sketch(a), jaccard.dense_sketch(b), len(a), len(b)) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    for few in (0, 1000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and len(got) == 71
