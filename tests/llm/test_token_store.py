"""Round trips of the file format, and the tokenizers library as the judge of ids."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import token_store as ts

PATH = P.path("word_bpe_49k.json")
WORDS = ts.Words(PATH)
LIBRARY = Tokenizer.from_file(PATH)  # as it comes: special tokens in texts are special
TEXTS = ["", " ", "Hello World", "a  b\n\nc\td", "it's WE'LL 123 !!! <|endoftext|> x", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|> <| x", "é é   日本語", "\x0b\x0c x\x85y", "ß ΑΣ ΑΣΑ İ", "x" * 3000, "\r\n  tail "]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 49407), st.integers(0, 2**32 - 1)), max_size=700))
def test_ids_round_trip(ids):
    data = ts.encode_ids(np.array(ids, np.uint32))
    assert ts.decode_ids(data).tolist() == ids
    for b in range(-(-len(ids) // 128)):
        assert ts.read_block(data, b).tolist() == ids[128 * b : 128 * b + 128]


def test_damage_is_noticed():
    data = bytearray(ts.encode_segment(np.arange(300, dtype=np.uint32), [1, None], np.array([100, 200])))
    ids, docs, counts = ts.decode_segment(bytes(data))
    assert ids.tolist() == list(range(300)) and docs == [1, None] and counts.tolist() == [100, 200]
    data[-1] ^= 1
    with pytest.raises(ValueError):
        ts.decode_segment(bytes(data))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZqé'ßÖŁıſİžŉ×÷9_!-&s.\u0301\u0307ΣÅ日 \n\t\x0b\x1c")), max_size=24))
def test_cached_pieces_equal_the_library(text):
    assert WORDS.encode([text.encode()])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_batches_of_many_texts_equal_the_library():
    rng = np.random.default_rng(8)
    signs = list("abcdefgÀéß ŁžQ.,!'’019-日\u0301 ") + ["<|endoftext|>", " ", " "]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(1500)]
    words = ts.Words(PATH)
    words.cache = ts.common.Cache(700)  # several generations
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        ids, counts = words.encode([t.encode() for t in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in part]
    ids, counts = words.encode([b"a\xff b", None, b"", b"c"])
    assert ids.tolist() == LIBRARY.encode("a\ufffd b", add_special_tokens=False).ids + LIBRARY.encode("c", add_special_tokens=False).ids and counts[1] == counts[2] == 0


def test_files_hold_what_the_library_gives(spark, tmp_path):
    rows = [(i * 3, t, 0) for i, t in enumerate(TEXTS * 20)] + [(1, None, 0), (None, "a b", 0), (6, "again", 0)]
    ts.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(7), f"file://{tmp_path}/t", PATH)
    got = sorted(ts.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2])
    place = 0
    for r in got:
        assert r.start == place and list(r.token_ids) in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) and r.n_tokens == len(r.token_ids)
        place += r.n_tokens


def test_empty_table(spark, tmp_path):
    ts.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", PATH)
    assert ts.read_tokens(spark, f"file://{tmp_path}/e").count() == 0
