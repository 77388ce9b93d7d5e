"""Seed and extend against windows compared one by one."""

import hashlib
import random
import re

import numpy as np

from lexispark.llm import substring


def brute(rows, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [draw(n) for n in (49, 50, 51, 60, 120, 300)]
    rows = []
    for k in range(120):
        w = draw(rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 48))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : a + rng.randrange(40, 200)]
        rows.append("  \n".join(w) if k % 3 else " ".join(w))
    rows += rows[:10] + [" ".join(["same"] * n) for n in (49, 50, 51, 200, 90)] + [" ".join(passages[5] * 3), "", None, "\t "]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df).collect()}
    assert got == brute(rows)


def test_long_text_uses_ranks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(600)).encode()
    one = substring.Batch([text, b"a b"], 50, 20)
    monkeypatch.setattr(substring, "PLACE_BITS", np.uint64(9))
    two = substring.Batch([text, b"a b"], 50, 20)
    assert len(one.anchor) == len(two.anchor) == 551
    assert (one.grams[one.anchor] <= one.grams[one.starts]).all() and (two.grams[two.anchor] <= two.grams[two.starts]).all()


def test_ids_missing_or_repeated_and_empty_tables(spark):
    long = " ".join(f"x{i}" for i in range(70))
    df = spark.createDataFrame([(None, long), (4, long), (4, long), (9, long), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(df).collect()), key=str)
    assert got == sorted([(None, 70, 0), (4, 70, 0), (4, 70, 0), (9, 70, 70), (2, 0, 0)], key=str)
    assert substring.substring_dedup(df.limit(0)).count() == 0
