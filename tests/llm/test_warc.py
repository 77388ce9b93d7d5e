"""Archives read back, checked against a plain statement of the rules."""

import glob
import hashlib

from lexispark.llm import warc


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    return {i: (len(p := (h or "").encode()), hashlib.sha256(p).hexdigest(), *(("revisit", first[p]) if p in first and first[p] != i else ("response", None))) for i, _, h in rows}


def test_round_trip(spark, tmp_path):
    long = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é<p>x\r\n\r\n" * 20
    rows = [(i, f"http://h/{i % 3}", ["a" * 99, "b" * 100, long, None, "", "\r\n" * 60, "日本" * 40 + "\n"][i % 7]) for i in range(5, 60)]
    rows += [(70, "http://h/\r\nX: y%41 ü", "c" * 300), (71, None, "c" * 300), (None, "u", "c" * 300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(5)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    got = warc.payloads(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows)
    want, html, urls = expected(rows), {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", 70)
        else:
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
        assert bytes(r.payload) == (html[r.page_id] or "").encode() and r.url == urls[r.page_id]


def test_empty_table_and_damage(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
    try:
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))
    except ValueError:
        return
    raise AssertionError("a wrong length went unnoticed")


def test_files_are_bounded_though_sizes_are_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    rows = [(i, f"http://h/{i}", f"{i} " * 20) for i in range(300)] + [(1000 + i, "http://big", f"{i}" * 9_000) for i in range(10)] + [(2000 + i, "http://huge", f"{i}" * 400_000) for i in range(2)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    files = [list(warc.parse(warc.gunzip(open(f, "rb").read()))) for f in glob.glob(f"{tmp_path}/w/*.gz")]
    assert sum(map(len, files)) == len(rows)
    assert all(len(f) <= 1 or sum(len(block) for _, block in f) <= warc.GROWTH * warc.FILE_BYTES for f in files)
    assert max(map(len, files)) > 1
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {i: h for i, _, h in rows}


def test_repeated_rows_of_the_least_id_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "v", "x" * 200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.payloads(got).where("payload is null").isEmpty()
