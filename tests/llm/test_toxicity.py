"""The factorization machine: gradients' result on pairs, held-out accuracy, edge cases."""

import numpy as np

from lexispark.llm import toxicity


def test_raw_score_is_the_sum_over_pairs():
    m = toxicity.Machine(6)
    m.w0, m.w = 0.3, np.arange(6) / 10
    own = np.array([0, 2, 5])
    want = 0.3 + m.w[own].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(own) for b in own[i + 1 :])
    assert abs(m.raw([own, np.zeros(0, int)])[0] - want) < 1e-9 and m.raw([np.zeros(0, int)])[0] == 0.3


def linear_accuracy(sets, labels):
    m = toxicity.Machine(12)
    m.v[:] = 0  # no gradient leaves zero
    return np.mean((m.fit(sets, labels, epochs=15).score(sets) >= 0.5) == labels)


def test_pairs_that_no_linear_model_can_tell():
    rng = np.random.default_rng(2)
    sets, labels = [], []
    for _ in range(4000):
        a, b = (rng.random(2) < 0.5).tolist()
        sets.append(np.array([0] * a + [1] * b + [int(rng.integers(2, 12))]))
        labels.append(float(a != b))
    labels = np.array(labels)
    m = toxicity.Machine(12).fit(sets, labels, epochs=25)
    assert np.mean((m.score(sets) >= 0.5) == labels) > 0.97
    assert linear_accuracy(sets, labels) < 0.8


def test_pair_sums_equal_a_plain_count():
    texts = ["a b c a b", "x", "", "b a é é q r s t u v"]
    doc, a, b = toxicity.Pairs().of(texts)
    place = lambda w: toxicity.terms_of(w)[0]
    want = set()
    for k, t in enumerate(texts):
        w = t.split()
        want |= {(k, *sorted((place(x), place(y)))) for i, x in enumerate(w) for y in w[i + 1 : i + 1 + toxicity.REACH] if place(x) != place(y)}
    assert set(zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)) == want and len(doc) == len(want)


def test_an_insult_with_a_group_whose_words_are_harmless_alone(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(4000):
        words = [f"wort{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26)}" for x in rng.integers(0, 400, 30)]
        kind = i % 4  # neither, the one, the other, both next to each other; marked are those with exactly one
        at = int(rng.integers(1, 28))
        words[at:at] = [[], ["rats"], ["martians"], ["martians", "are", "rats"]][kind]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind in (1, 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    inputs, machine = learned = toxicity.learn(docs, marks.where(toxicity.fold() != 2))
    assert all(inputs[toxicity.terms_of(w)[0]] >= 0 for w in ("rats", "martians"))
    held = {i for i in range(4000) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: r.score for r in toxicity.score(docs, learned).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 in (1, 2)) for i in held]) > 0.95


def test_held_out_and_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1200):
        words = [f"wort{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26)}" for x in rng.integers(0, 500, int(rng.integers(3, 60)))]
        bad = i % 6 == 0
        if bad:
            words[int(rng.integers(len(words)))] = ["idiot", "loweixx", "loweiyy", "scum"][i // 6 % 4]
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(bad)))
    rows += [(5000, None, 1.0), (5001, "", 1.0), (None, "idiot scum", 1.0), (5002, "loweizz wortaa", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (0, 0)], "doc_id long, toxic int").where(toxicity.fold() != 2)
    learned = toxicity.learn(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, learned).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(1200) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert got[5000].score == got[5001].score < 0.3 and got[None].predicted == 1 and got[5002].predicted == 1
    assert toxicity.learn(docs, marks.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), learned).count() == 0
