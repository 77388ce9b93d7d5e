"""The pipeline on a small corpus with planted cases, stage by stage against plain statements of what must happen."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_substring import brute as cuts


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = ["the", "of", "and", "to"] * 40 + [f"word{i}" for i in range(1500)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(draw(30)) + ".") for i in range(10)]
    passage = draw(70)
    rows, labels = [], []
    for i in range(300):
        w = draw(rng.randrange(20, 200))
        if i % 10 == 3:
            w[rng.randrange(len(w))] = "moron"
        labels.append((i, int(i % 10 == 3)))
        if i % 10 == 5:
            at = rng.randrange(len(w))
            w[at:at] = items[i // 10 % 10][1].split()
        if i % 10 == 7:
            w[5:5] = passage
        if i % 10 == 8:
            w = list(rows[i - 2][1].split(" "))
            w[0] = "other"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "", None, None, None), (0, rows[0][1], "en", "s", 0), (None, "a row without id", "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name == "byte_bpe":
            got = out.collect()
            assert len(got) == len(before) and all(len(r.token_ids) == r.n_tokens for r in got)
            continue
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            assert {x for x, _ in before} - {x for x, _ in after} == {x for x, t in before if "moron" in (t or "")}
        elif name == "ngram_jaccard_join":
            roots = groups([(x, t) for x, t in before if x is not None])
            assert sorted(x for x, _ in after if x is not None) == sorted(x for x, (_, root) in roots.items() if x == root)
            assert sum(x is None for x, _ in after) == 1
        elif name == "substring_dedup":
            want = cuts([(x, t) for x, t in before if x is not None])
            assert {x: len((t or "").split()) for x, t in after if x is not None} == {x: n - cut for x, (n, cut, _) in want.items()}
            assert sum(cut for _, cut, _ in want.values()) > 1000
        elif name == "benchmark_decontamination":
            assert {x for x, _ in before} - {x for x, _ in after} == {x for x, t in before if any(i in (t or "") for i in items)}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {1000, 1001, None} <= {r.doc_id for r in rows}
