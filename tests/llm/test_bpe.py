"""Byte-level BPE against the tiktoken library and against the pattern itself."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TRICKY = ["", " ", "  ", "a", "'s", "it's", "it 's", "we'll've 're'd", "!'s", "  's", "\n's", "'re", "'r", "''s", "x  y", "x \n y", "a b", " 12ab!!", "\t\tz ", "…", "日本語 テキスト", "é", "🙂🙂 ok", "a" * 900, "ab" * 450, " x", "'S", "I'm'm", "can't.\r\n\r\n  Go"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ9 '\n\tsremvld!é日 　🙂٣")), max_size=40))
def test_split_is_the_pattern(text):
    assert bpe.split(text) == regex.findall(P.PATTERN, text)


def test_batch_equals_library(library):
    ranks = bpe.Ranks(PATH)
    ids, counts = bpe.encode_texts(ranks, TRICKY)
    for own, text in zip(np.split(ids, np.cumsum(counts)[:-1]), TRICKY, strict=True):
        assert own.tolist() == library.encode_ordinary(text), text
        assert ranks.decode(own)[0].tobytes() == text.encode()


def test_span_decoding():
    ranks = bpe.Ranks(PATH)
    text = "The quick bröwn fox, it's 日本語."
    ids, _ = bpe.encode_texts(ranks, [text])
    assert bpe.decode_span(ranks, ids, 4, 12) == text.encode()[4:12]


def test_generations_of_the_cache(library):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'äbé'[int(x) % 3]}w{int(x)}" for x in rng.zipf(1.3, 40) % 5000) for _ in range(300)]
    ranks = bpe.Ranks(PATH)
    ranks.cache = bpe.common.Cache(200)
    for i in range(0, 300, 20):
        ids, counts = bpe.encode_texts(ranks, texts[i : i + 20])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts[i : i + 20]]


def test_operator(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(100, None, None), (None, "a b", "x"), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(df, PATH, with_offsets=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and list(r.token_ids) == ids
        sizes = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert list(r.byte_offsets) == [sum(sizes[:k]) for k in range(len(ids))]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH).count() == 0
