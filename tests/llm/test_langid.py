"""Language models: probabilities that add up, agreement with a plain recursion, held-out accuracy."""

from collections import Counter

import numpy as np

from lexispark.llm import langid

WORDS = {
    "en": "the and of that with this from which would there their about other words house water people".split(),
    "de": "der die das und nicht mit einer werden haben schön straße menschen wasser häuser".split(),
    "fr": "le la les des que dans pour avec être était maison beaucoup français élève".split(),
}


def model():
    return langid.Model({lang: langid.count_keys(Counter({w: i + 1 for i, w in enumerate(words)})) for lang, words in WORDS.items()})


def plain(counts, history, code, discounts):
    """Interpolated Kneser-Ney by its definition, on tuples of codes."""
    m = len(history) + 1
    if m == 0:
        return 0
    table = counts[m]
    total = sum(v for k, v in table.items() if k[:-1] == history)
    kinds = sum(1 for k in table if k[:-1] == history)
    low = plain(counts, history[1:], code, discounts) if m > 1 else 1 / 4096
    if not total:
        return low
    d = discounts[m]
    return max(table.get((*history, code), 0) - d, 0) / total + d * kinds / total * low


def test_scores_equal_the_definition():
    for lang, words in WORDS.items():
        raw = [Counter() for _ in range(6)]
        for i, w in enumerate(words):
            codes, _ = langid.codes_of([w])
            c = tuple(codes.tolist())
            for j in range(1, len(c)):
                g = c[max(0, j - 4) : j + 1]
                raw[len(g)][g] += i + 1
        counts = [None] * 6
        counts[5] = dict(raw[5])
        for m in range(4, 0, -1):
            own = Counter(k[1:] for k in counts[m + 1])
            own.update(raw[m])
            counts[m] = dict(own)
        discounts = {}
        for m in range(1, 6):
            a, b = sum(v == 1 for v in counts[m].values()), sum(v == 2 for v in counts[m].values())
            discounts[m] = min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
        for w in ["the", "straße", "wxyz", "êtr", "menschenhaus", "a"]:
            c = tuple(langid.codes_of([w])[0].tolist())
            want = sum(np.log(plain(counts, c[max(0, j - 4) : j], c[j], discounts)) for j in range(1, len(c)))
            got = model().score_runs([w])[0]
            assert abs(got[model().langs.index(lang)] - want) < 1e-3 and got[-1] == len(w) + 1


def test_held_out_accuracy_and_edge_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 25)), lang) for i, lang in enumerate(list(WORDS) * 60)]
    rows += [(1000, None, "en"), (1001, "12 ... !!", "de"), (1002, "", None), (1003, "the water", None), (None, "la maison", "fr"), (1004, "Жжж щщщ ъъъ ыыы", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    learn = df.where(langid.fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in langid.identify(df, learn).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:180])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "fr" and got[1004].rejected and not got[0].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df, learn.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), learn).count() == 0


def test_groups_of_languages_drop_no_ngram(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 25)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    whole = {r.doc_id: r for r in langid.identify(df, df).collect()}
    monkeypatch.setattr(langid, "MODEL_KEYS", 30)
    got = {r.doc_id: r for r in langid.identify(df, df).collect()}
    assert len(list(langid.learn_counts(df, "text", "lang"))) == 3
    for lang, (keys, times) in ((k, v) for part in langid.learn_counts(df, "text", "lang") for k, v in part.items()):
        want = langid.count_keys(Counter(w for _, t, x in rows if x == lang for w in t.split()))
        assert np.array_equal(keys, want[0]) and np.array_equal(times, want[1])
    for i, r in whole.items():
        assert got[i].lang_pred == r.lang_pred and abs(got[i].cross_entropy - r.cross_entropy) < 1e-5 and abs(got[i].score - r.score) < 1e-4


def test_groups_are_bounded_and_hold_all():
    groups = langid.groups_of({f"l{i:03}": 400_000 for i in range(100)} | {"big": 9_000_000})
    assert sorted(x for g in groups for x in g) == sorted([f"l{i:03}" for i in range(100)] + ["big"])
    assert ["big"] in groups and max(map(len, groups)) == 3


def test_calibration_sums_equal_the_definition():
    rng = np.random.default_rng(4)
    h, right = rng.uniform(1, 4, (500, 3)), rng.integers(0, 2, 500)
    h[np.arange(500), right] -= 0.7
    sums = langid.Calibration(3)
    for i in range(0, 500, 90):
        part = langid.Calibration(3)
        for j in range(i, min(500, i + 90), 40):
            part.add(h[j : min(j + 40, i + 90, 500)], right[j : min(j + 40, i + 90, 500)])
        sums.add_packed(part.packed())
    temperature, limits = sums.result()
    loss = [np.mean(np.log(np.exp(-h / t - (-h / t).max(1, keepdims=True)).sum(1)) - (-h / t - (-h / t).max(1, keepdims=True))[np.arange(500), right]) for t in langid.TEMPERATURES]
    assert temperature == langid.TEMPERATURES[np.argmin(loss)] and sums.n.tolist() == [*np.bincount(right, minlength=3)]
    assert all(np.isclose(limits[i], (own := h[right == i, i]).mean() + 6 * own.std() + 0.3) for i in (0, 1)) and np.isinf(limits[2])


def test_calibration_takes_every_learning_row(spark, monkeypatch):
    rows = [(i, f"the house {i % 7} water", "en") if i % 2 else (i, "das haus und wasser", "de") for i in range(4600)] + [(9000, None, "en"), (9001, "maison", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen, result = [], langid.Calibration.result
    monkeypatch.setattr(langid.Calibration, "result", lambda self: (seen.append(self.n.tolist()), result(self))[1])
    langid.identify(df.limit(1), df)
    assert seen == [[2300.0, 2300.0]]
