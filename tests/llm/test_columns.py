"""Other columns of the input: whatever they are called they come through, repeated rows and very long texts as well."""

import public_tokenizers as P
import pytest

from lexispark.llm import bpe, decontaminate, html_text, jaccard, langid, substring, toxicity

NAMES = ["_utf8", "_found", "found", "found_id", "_found_id", "raw", "page", "removed", "_url", "_html", "_page", "at", "node", "label", "_label_id", "_doc_id", "sets", "h", "a`b", "c.d", "c0", "_decided"]
LONG = "the water house and people of that which there about " * 6000


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the people of that house about which", "der mensch und das haus mit wasser", None, "", LONG, "the people of that house about which"]
    rows = [(i % 5, t, "en" if i != 1 else "de", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)).repartition(3)


def same(before, after, without=()):
    keep = [c for c in before.columns if c not in without]
    rows = lambda df: sorted((tuple(r[c] for c in keep) for r in df.collect()), key=str)
    assert rows(before) == rows(after)


def test_texts(spark, docs):
    same(docs, langid.identify(docs, docs))
    same(docs, bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), with_ids=False))
    marks = spark.createDataFrame([(0, 1), (1, 0), (4, 0)], "doc_id long, toxic int")
    same(docs, toxicity.score(docs, toxicity.learn(docs, marks)))
    bench = spark.createDataFrame([(1, "der mensch und das haus mit wasser")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    same(docs, out)
    assert [r.doc_id for r in out.where("contaminated").collect()] == [1]
    same(docs, substring.substring_dedup(docs), without=["text"])
    members = jaccard.jaccard_join(docs)[1].collect()
    assert sorted((r.doc_id, r.component_id) for r in members) == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]


def test_pages(spark, docs):
    pages = docs.withColumnRenamed("lang", "url").withColumnRenamed("text", "html")
    out = html_text.extract(pages)
    same(pages, out, without=["html"])
    assert max(r.n_chars for r in out.collect()) == len(LONG) - 1
