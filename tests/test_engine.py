"""Distances, sources, searches, tree statistics and streams against goldens and brute force."""

import bisect
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark import __main__ as modes
from lexispark.functions import osa as osa_module
from lexispark.functions.text import auto_distance, bit_kernel_fits, byte_string
from lexispark.operators import compare, render, search, tree
from lexispark.plans import catalog
from lexispark.sources import dictionary
from lexispark.streaming.search_stream import answer_batch, answer_stream, line_stream

#: Known pairs and their distances.
GOLDEN = [("kitten", "sitting", 3), ("Saturday", "Sunday", 3), ("gifts", "profit", 5), ("Something", "Smoething", 1), ("Pomatomus", "Pomatomus", 0), ("kynar", "kaynar", 1), ("kynar", "kayna", 2), ("muahahah", "muhahahah", 1), ("sakit", "safekit", 2), ("ca", "abc", 3), ("é", "e", 2), ("", "abc", 3), ("abc", "", 3), ("", "", 0), ("a" * 70, "a" * 69 + "b", 1)]


def test_goldens(spark):
    rows = [(a, b, d) for a, b, d in GOLDEN] + [(b, a, d) for a, b, d in GOLDEN]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    got = df.select("want", osa_module.osa(byte_string(F.col("a")), byte_string(F.col("b"))).alias("x"), osa_module.osa_arrow("a", "b").alias("y")).collect()
    assert all(r.want == r.x == r.y for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=9), st.binary(max_size=9)), min_size=1, max_size=20))
def test_batch_kernel(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert osa_module.osa_pairs(a, b).tolist() == [osa_module.osa_python(x, y) for x, y in pairs]


def test_bit_kernel_around_the_width_of_a_word():
    rng = random.Random(8)
    pairs = []
    for n in (1, 2, 31, 63, 64, 65, 66, 130):
        for _ in range(12):
            x = bytes(rng.choice(b"abc\xc3") for _ in range(n))
            y = list(x)
            for _ in range(rng.randrange(4)):
                p = rng.randrange(len(y))
                if rng.random() < 0.5 and p:
                    y[p - 1], y[p] = y[p], y[p - 1]
                else:
                    y[p : p + rng.randrange(2)] = [97] * rng.randrange(3)
                y = y or [98]
            pairs.append((x, bytes(y)))
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    want = [osa_module.osa_python(x, y) for x, y in pairs]
    assert osa_module.osa_pairs(a, b).tolist() == osa_module.osa_pairs(b, a).tolist() == osa_module.table_pairs(a, b).tolist() == want


def test_prefix_distances(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in GOLDEN[:13]], "a string, b string")
    for r in df.select("a", "b", osa_module.prefix_distances(byte_string(F.col("a")), byte_string(F.col("b"))).alias("d")).collect():
        x, y = r.a.encode(), r.b.encode()
        assert r.d == [osa_module.osa_python(x[:i], y) for i in range(len(x) + 1)]


def test_expression_equals_definition(spark):
    rng = random.Random(2)
    draw = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(7)))
    pairs = [(draw(), draw()) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": byte_string(F.col("a")), "y": byte_string(F.col("b"))})
    for r in df.select("a", "b", osa_module.osa(F.col("x"), F.col("y")).alias("d"), osa_module.within(F.col("x"), F.col("y"), F.lit(2)).alias("w"), osa_module.row_minima(F.col("x"), F.col("y")).alias("m")).collect():
        want = osa_module.osa_python(r.a.encode(), r.b.encode())
        assert r.d == want and r.w == (want if want <= 2 else None)
        assert len(r.m) == len(r.a.encode()) + 1 and max(r.m) <= want


def vocabulary(seed=4):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(500)}
    words |= {"".join(rng.choice("xyz") for _ in range(rng.randrange(10, 16))) for _ in range(60)} | {'q"uote', "test", "other"}
    return [(w, rng.randrange(1, 50)) for w in sorted(words)]


@pytest.mark.parametrize("strategy", ["auto", "variants", "lengths", "segments"])
def test_search_equals_brute_force(spark, strategy):
    words = vocabulary()
    rng = random.Random(6)
    queries = []
    for i in range(90):
        w = list(rng.choice(words)[0])
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("abxé"))
        queries.append((i, i % 4 if strategy == "variants" else i % 5, "".join(w)))
    queries += [(900, 1, "nothinglikeit"), (901, 9, "ab")] if strategy != "variants" else []
    q = spark.createDataFrame(queries, "qid long, max_distance int, word string")
    d = spark.createDataFrame(words, "word string, freq long")
    got = {r.qid: [(x.word, x.freq, x.distance) for x in r.results] for r in search.answers(q, search.fuzzy(q, d, strategy)).collect()}
    for qid, k, w in queries:
        near = [(v, f, osa_module.osa_python(w.encode(), v.encode())) for v, f in words if abs(len(w.encode()) - len(v.encode())) <= k]
        want = sorted([x for x in near if x[2] <= k], key=lambda x: (x[2], -x[1], x[0].encode()))
        assert got[qid] == want, (qid, k, w)


def test_variant_index_equals_the_plan_without(spark, tmp_path, monkeypatch):
    words = spark.createDataFrame(vocabulary(), "word string, freq long")
    dictionary.write_variants(words, f"file://{tmp_path}/v", 2)
    variants = dictionary.read_variants(spark, f"file://{tmp_path}/v")
    q = spark.createDataFrame([(i, i % 3, w[::-1] if i % 2 else w + "a") for i, (w, _) in enumerate(vocabulary(9)[::7])], "qid long, max_distance int, word string")
    rows = lambda df: sorted((r.qid, r.word, r.freq, r.distance) for r in df.collect())
    want = rows(search.fuzzy(q, words, "lengths"))
    assert rows(search.fuzzy(q, words, variants=variants)) == want and len(want) > 50
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)  # the shuffled form
    assert rows(search.fuzzy(q, words, variants=variants)) == rows(search.fuzzy(q, words, "variants")) == want


def test_files_of_queries_and_answers_keep_their_order(spark, tmp_path):
    words = spark.createDataFrame(vocabulary(), "word string, freq long")
    lines = dictionary.query_lines(words.orderBy("word"), 1).select("value").coalesce(1)
    lines.write.text(f"file://{tmp_path}/lines", lineSep="\n")
    source = next((tmp_path / "lines").glob("*.txt"))
    asked = source.read_text().split("\n")[:-1]
    assert all(x.startswith("approx 1 ") for x in asked)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # several partitions of one file
    try:
        q = dictionary.read_queries(spark, f"file://{source}")
        assert q.rdd.getNumPartitions() > 2
        assert [(r.qid, r.word) for r in q.orderBy("qid").collect()] == [(i, x.split(" ")[2]) for i, x in enumerate(asked)]
        render.write_answers(search.answers(q, search.fuzzy(q, words)), f"file://{tmp_path}/answers")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = "".join(p.read_text() for p in sorted((tmp_path / "answers").glob("*.txt"))).split("\n")[:-1]
    data = vocabulary()
    for x, line in zip(asked, got, strict=True):
        w = x.split(" ")[2].encode()
        near = sorted((osa_module.osa_python(w, v.encode()), -f, v.encode()) for v, f in data if abs(len(v.encode()) - len(w)) < 2)
        assert line == "[" + ",".join(f'{{"word":"{v.decode()}","freq":{-f},"distance":{d}}}' for d, f, v in near if d < 2) + "]"


def test_drawing_has_its_frame(spark, tmp_path):
    tree.write_dot(spark.createDataFrame([("a", 3), ("ab", 1)], "word string, freq long"), f"file://{tmp_path}/dot")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("*.txt"))).split("\n")[:-1]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and all(x.endswith(";") for x in lines[1:-1])
    assert 'n61 [label="3", shape=hexagon, color=green, style=filled];' in lines and 'n61 -> n6162 [label="b"];' in lines


def test_entry_points(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text("hello\t10\nhelp\t5\nworld\t1\n")
    (tmp_path / "q.txt").write_text("approx 1 helo\napprox 0 world\n")
    index = f"file://{tmp_path}/index"
    modes.compile_index(spark, f"file://{tmp_path}/d.txt", index, "1")
    modes.answer(spark, index, f"file://{tmp_path}/q.txt", f"file://{tmp_path}/out")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.txt"))) == '[{"word":"hello","freq":10,"distance":1},{"word":"help","freq":5,"distance":1}]\n[{"word":"world","freq":1,"distance":0}]\n'
    assert modes.info(spark, index).first().words == 3
    modes.graph(spark, index, f"file://{tmp_path}/graph")
    assert modes.bench(spark, index, "1", runs=5).first().median > 0
    assert {(r.word, r.distance) for r in modes.smoke(spark).collect()} == {("hello", 1), ("help", 1)}
    with pytest.raises(SystemExit):
        modes.main(["unknown"])


def test_json_and_extensions(spark):
    q = spark.createDataFrame([(1, 1, "test"), (2, 0, "none"), (3, 1, 'q"uot')], "qid long, max_distance int, word string")
    d = spark.createDataFrame([("test", 3), ("tests", 9), ("tesT", 9), ('q"uote', 2)], "word string, freq long")
    matches = search.fuzzy(q, d)
    got = {r.qid: (r.x, r.y) for r in search.answers(q, matches).select("qid", render.json_exact(F.col("results")).alias("x"), render.json_valid(F.col("results")).alias("y")).collect()}
    assert got[1][0] == '[{"word":"test","freq":3,"distance":0},{"word":"tesT","freq":9,"distance":1},{"word":"tests","freq":9,"distance":1}]' == got[1][1]
    assert got[2] == ("[]", "[]") and got[3] == ('[{"word":"q"uote","freq":2,"distance":1}]', '[{"word":"q\\"uote","freq":2,"distance":1}]')
    assert [r.word for r in search.suggestions(matches, 1).where("qid = 1").collect()] == ["test"]
    assert {r.word for r in search.unmatched(q, d).collect()} == {"none", 'q"uot'}


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes("a\t3\r\nb 1 x y\n  c 7\na 9\n".encode())
    assert {(r.word, r.freq) for r in dictionary.read_dictionary(spark, f"file://{tmp_path}/d.txt").collect()} == {("a", 9), ("b", 1), ("c", 7)}
    bad = ["x", "x 0", "x 4294967296", "x -1", "x abc", "x 5.7", "", "   "]
    lines = spark.createDataFrame([(b,) for b in [*bad, "ok +5", "max 4294967295"]], "value string")
    parsed = dictionary.parse_lines(lines, strict=False).collect()
    assert {r.corrupt for r in parsed if r.corrupt is not None} == set(bad) and {(r.word, r.freq) for r in parsed if r.word} == {("ok", 5), ("max", 4294967295)}
    with pytest.raises(Exception, match="bad dictionary line"):
        dictionary.parse_lines(lines).collect()
    (tmp_path / "q.txt").write_text("approx 1 foo more\nx 0 bar\n")
    assert [(r.qid, r.max_distance, r.word) for r in dictionary.read_queries(spark, f"file://{tmp_path}/q.txt").orderBy("qid").collect()] == [(0, 1, "foo"), (1, 0, "bar")]
    words = spark.createDataFrame([("b", 1), ("a", 2), ("a", 5)], "word string, freq long")
    dictionary.write_index(words, f"file://{tmp_path}/index", 2)
    assert {(r.word, r.freq, r.len) for r in dictionary.read_index(spark, f"file://{tmp_path}/index").collect()} == {("a", 5, 1), ("b", 1, 1)}


def test_scalars(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("abcdefghij",), ("é" * 3,)], "w string")
    assert [r.k for r in df.select(auto_distance(F.col("w")).alias("k")).collect()] == [1, 2, 3, 2]
    assert [r.b for r in df.select(bit_kernel_fits(F.col("w"), F.lit(56)).alias("b")).collect()] == [True, True, False, False]


def plain_tree(words):
    """A recursive statement of the compressed tree: (nodes, height, kinds, edges)."""
    data = {w.encode(): f for w, f in words}
    every = {w[:i] for w in data for i in range(len(w) + 1)} or {b""}
    children = {p: sorted(c for c in every if len(c) == len(p) + 1 and c[:-1] == p) for p in every}
    kinds, edges = [], []

    def visit(p, root):
        start = p
        for _ in range(7):
            if len(children[p]) == 1 and p not in data:
                p = children[p][0]
            else:
                break
        n = len(children[p])
        kinds.append("node256" if root or n > 48 else "node48" if n > 16 else "node16" if n > 4 else "node4" if n else "node0")
        deep = [(visit(c, False), c) for c in children[p]]
        for (h, q), _ in deep:
            edges.append((p, q, q[len(p):]))
        return (1 + max((h for (h, _), _ in deep), default=0 if root else -1), p) if deep or not root else (1, p)

    height, _ = visit(b"", True)
    return len(kinds), height, kinds, edges


@pytest.mark.parametrize("seed", range(3))
def test_tree(spark, seed):
    rng = random.Random(seed)
    words = [(w, i + 1) for i, w in enumerate({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "cccccccccccccccccccc", "ddddddddé"]) for _ in range(25)})]
    df = spark.createDataFrame(words, "word string, freq long")
    n, height, kinds, edges = plain_tree(words)
    r = tree.information(df).first()
    assert (r.words, r.nodes, r.height, r.max_length) == (len(words), n, height, max(len(w.encode()) for w, _ in words) + 1)
    assert {x.kind: x.n for x in tree.node_kinds(df).collect()} == {k: kinds.count(k) for k in set(kinds)}
    assert tree.index_bytes(df).first().bytes == sum(tree.NODE_BYTES[k] for k in kinds)
    assert {(x.parent.encode("latin-1"), x.child.encode("latin-1"), x.label.encode("latin-1")) for x in tree.tree_edges(df).collect()} == set(edges)
    assert tree.dot_lines(df).count() == n + len(edges)


def test_tree_of_nothing(spark):
    r = tree.information(spark.createDataFrame([], "word string, freq long")).first()
    assert (r.words, r.nodes, r.height, r.max_length) == (0, 1, 1, 1)


def by_prefixes(words):
    """Words and forks by their definition: {prefix: (above, n_children, freq)}, and the height."""
    every = {w[:i] for w in words for i in range(len(w) + 1)}
    n_children = {p: sum(c[:-1] == p for c in every if c) for p in every}
    own = {p for p in every if n_children[p] != 1 or p in words}
    above = {p: max((i for i in range(len(p)) if p[:i] in own), default=-1) for p in own}
    depth = lambda w: sum(tree.stay(i, above[w[:i]]) for i in range(len(w) + 1) if w[:i] in own) - 1
    return {p: (above[p], n_children[p], words.get(p)) for p in own}, max(map(depth, words))


def test_ranges_of_sorted_words_add_up():
    rng = random.Random(3)
    for _ in range(300):
        words = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))) + rng.choice([b"", b"", b"c" * 20, b"d" * 9]): rng.randrange(1, 9) for _ in range(rng.randrange(1, 14))}
        srt = sorted(words)
        cuts = sorted(rng.sample(range(len(srt) + 1), rng.randrange(2)) + rng.sample(range(len(srt) + 1), rng.randrange(2)))
        ranges = [srt[a:b] for a, b in zip([0, *cuts], [*cuts, len(srt)], strict=True)]
        rng.shuffle(ranges)
        rows = [row for part in ranges for row in tree.range_rows([(x, [words[w] for w in x]) for x in (part[:2], part[2:]) if x])]
        more, height = tree.joined(row for row in rows if row[0] != tree.WHOLE)
        got = [(r[1], r[2], r[3] + (not r[4]), r[5]) for r in rows if r[0] == tree.WHOLE] + more
        want, want_height = by_prefixes(words)
        assert len(got) == len(want) and {p: tuple(r) for p, *r in got} == want and height == want_height


def test_many_ranges_of_nested_words_add_up():
    rng = random.Random(5)
    for _ in range(300):
        words = {b"a" * rng.randrange(30) + bytes(rng.choice(b"ab") for _ in range(rng.randrange(5))): rng.choice([None, 1, 2]) for _ in range(rng.randrange(1, 25))}
        srt = sorted(words)
        cuts = sorted(rng.randrange(len(srt) + 1) for _ in range(rng.randrange(9)))
        ranges = [srt[a:b] for a, b in zip([0, *cuts], [*cuts, len(srt)], strict=True)]
        rng.shuffle(ranges)
        rows = [row for part in ranges for row in tree.range_rows([([w], [words[w]]) for w in part])]
        more, height = tree.joined(row for row in rows if row[0] != tree.WHOLE)
        got = [(r[1], r[2], r[3] + (not r[4]), r[5]) for r in rows if r[0] == tree.WHOLE] + more
        want, want_height = by_prefixes(words)
        assert len(got) == len(want) and {p: tuple(r) for p, *r in got} == want and height == want_height


def sent_by_nested_words(spark, monkeypatch, query):
    """Bytes of words and prefixes that a query over words which all begin each other brings to the driver, in words of the longest."""
    words = spark.createDataFrame([("a" * k, k) for k in range(1, 301)], "word string, freq long")
    kept, collect = [], type(words).collect
    monkeypatch.setattr(type(words), "collect", lambda df: kept.extend(got := collect(df)) or got)
    out = query(words)
    return collect(out), sum(len(x) for row in kept for x in row if isinstance(x, (bytes, bytearray))) / 300


def test_dot_lines_of_nested_words_stay_off_the_driver(spark, monkeypatch):
    rows, sent = sent_by_nested_words(spark, monkeypatch, tree.dot_lines)
    assert len(rows) == 599 and sent <= 2 * 4


def test_edges_of_nested_words_stay_off_the_driver(spark, monkeypatch):
    rows, sent = sent_by_nested_words(spark, monkeypatch, tree.tree_edges)
    assert {(r.parent, r.child, r.label) for r in rows} == {("a" * k, "a" * (k + 1), "a") for k in range(1, 300)} and sent <= 2 * 4


def test_information_of_nested_words_stays_off_the_driver(spark, monkeypatch):
    rows, sent = sent_by_nested_words(spark, monkeypatch, tree.information)
    assert [(r.words, r.nodes, r.height, r.max_length) for r in rows] == [(300, 300, 299, 301)] and sent <= 2 * 4


def test_node_kinds_of_nested_words_stay_off_the_driver(spark, monkeypatch):
    rows, sent = sent_by_nested_words(spark, monkeypatch, tree.node_kinds)
    assert {r.kind: r.n for r in rows} == {"node256": 1, "node4": 298, "node0": 1} and sent <= 2 * 4


def sent_of_long_words(spark, folder, name):
    """The rows of a registered query over 200 words of 20,003 letters, and the bytes that all tasks send to the driver meanwhile, range samples of Spark's own included."""
    shared, letters = "a" * 20_000, "bcdefg"
    texts = [(k, shared + letters[k // 36] + letters[k // 6 % 6] + letters[k % 6]) for k in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(f"file://{folder}/documents.parquet")
    jsc = spark.sparkContext._jsc.sc()

    def stages():
        jsc.listenerBus().waitUntilEmpty(30_000)
        found = jsc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}

    before = stages()
    catalog.queries()[name](spark, f"file://{folder}").write.parquet(f"file://{folder}/out")
    sent = sum(size for stage, size in stages().items() if stage not in before)
    return spark.read.parquet(f"file://{folder}/out"), sent


#: Nodes of those words: of the first word's letters every eighth, then forks of letters (6 and 34 of 36), then words.
LONG_CHAIN, LONG_FORKS = 20_000 // 8, 6 + 34


def test_index_dot_of_long_words_sends_the_driver_no_sample(spark, tmp_path):
    rows, sent = sent_of_long_words(spark, tmp_path, "index_dot")
    assert rows.count() == 2 * (LONG_CHAIN + 1 + LONG_FORKS + 200) - 1 and sent < 500_000


def test_index_information_of_long_words_sends_the_driver_no_sample(spark, tmp_path):
    rows, sent = sent_of_long_words(spark, tmp_path, "index_information")
    assert [(r.words, r.nodes, r.max_length) for r in rows.collect()] == [(200, LONG_CHAIN + 1 + LONG_FORKS + 200, 20_004)] and sent < 500_000


def test_index_node_kinds_of_long_words_send_the_driver_no_sample(spark, tmp_path):
    rows, sent = sent_of_long_words(spark, tmp_path, "index_node_kinds")
    assert sum(r.n for r in rows.collect()) == LONG_CHAIN + 1 + LONG_FORKS + 200 and sent < 500_000


def test_beginnings_of_ranges_are_even_short_and_exact():
    rng = random.Random(9)
    for _ in range(200):
        words = sorted({b"a" * rng.randrange(40) + bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(60))})
        parts = rng.randrange(1, 9)
        begin = tree.whole_beginnings(tree.beginnings([(w, 1) for w in words], parts))
        assert begin == sorted(set(begin)) and len(begin) < parts
        sizes = [sum(bisect.bisect_right(begin, w) == k for w in words) for k in range(len(begin) + 1)]
        assert sum(sizes) == len(words) and max(sizes) <= -(-len(words) // parts) + 1
        most, most_bytes = rng.randrange(1, 20), rng.randrange(1, 200)
        kept = tree.drawn([words[:30], words[30:]], most, most_bytes)
        assert len(kept) <= 2 * most and sum(len(w) for w, _ in kept) <= most_bytes


def test_segments_leave_few_pairs_and_lose_none(spark, monkeypatch):
    """Words of 6 to 20 bytes don't meet on length; swaps around the cuts are found."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 21))) for _ in range(150)]

    def bent(w, n):
        for _ in range(n):
            i = rng.randrange(len(w) - 1)
            w = rng.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + "é" + w[i:], w[:i] + "q" + w[i + 1 :]])
        return w

    swapped = [w[: len(w) // 2 - 1] + w[len(w) // 2] + w[len(w) // 2 - 1] + w[len(w) // 2 + 1 :] for w in base]
    words = sorted({*base, *swapped, *(bent(w, 2) for w in swapped), *(bent(w, 3) for w in base)})
    asked = base[:40]
    q = spark.createDataFrame([(i, 3, w) for i, w in enumerate(asked)], "qid long, max_distance int, word string")
    d = dictionary.with_bytes(spark.createDataFrame([(w, 1) for w in words], "word string, freq long"))
    want = {(i, w, n) for i, a in enumerate(asked) for w in words if (n := osa_module.osa_python(a.encode(), w.encode())) <= 3}
    lengths, by_lengths = [], search.by_lengths
    monkeypatch.setattr(search, "by_lengths", lambda queries, part, **more: (lengths.append(part.agg(F.max("len")).first()[0]), by_lengths(queries, part, **more))[1])
    assert {(r.qid, r.word, r.distance) for r in search.fuzzy(q, d, "segments").collect()} == want
    assert all((n or 0) < 6 for n in lengths)
    pairs = search.by_one_edit_segments(q, d, 3, 6, 20).select("qid", "word").distinct().count()
    assert len(want) * 0.8 < pairs < 0.1 * len(asked) * len(words)


def hash_tables(df):
    """Joins by key of a plan: their build sides are what filled the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if x in plan]


def tree_words(spark):
    return spark.createDataFrame([(f"w{i % 7}{i}", i + 1) for i in range(50)], "word string, freq long")


def test_index_bytes_join_nothing(spark):
    assert not hash_tables(tree.index_bytes(tree_words(spark)))


def test_dot_lines_join_nothing(spark):
    assert not hash_tables(tree.dot_lines(tree_words(spark)))


def test_tree_edges_join_nothing(spark):
    assert not hash_tables(tree.tree_edges(tree_words(spark)))


def test_information_joins_nothing_by_key(spark):
    assert not hash_tables(tree.information(tree_words(spark)))


def test_node_kinds_join_nothing(spark):
    assert not hash_tables(tree.node_kinds(tree_words(spark)))


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "qid long, results string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, None)], "qid long, results string")
    assert sorted((r.qid, r.left, r.right) for r in compare.results_diff(a, b).collect()) == [(2, "y", "z"), (4, None, None)]
    t = spark.createDataFrame([("g", v) for v in (5, 1, 9, 2, 8, 3, 7, 4, 6, 100)], "g string, ms long")
    assert [(r.median, r.error) for r in compare.trimmed_stats(t, ["g"]).collect()] == [(6, 3)]
    words = spark.createDataFrame([(f"w{i:02}", 100 - i) for i in range(40)], "word string, freq long")
    mix = [(r.part, r.word) for r in compare.query_mix(words, 20, 75, queries=12).collect()]
    assert [w for p, w in mix if p == "head"] == [f"w{i:02}" for i in range(9)] and {w for p, w in mix if p == "tail"} == {"w37", "w38", "w39"}


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([("foo", 3), ("fob", 5), ("bar", 1)], "word string, freq long")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("2\tapprox 1 foo\n1\tapprox 0 bar\n3\tbroken\n4\tapprox 2 zzzzz\n")
    got = []
    query = answer_stream(line_stream(spark, f"file://{tmp_path}/in"), d, lambda df, _: got.extend((r.qid, r.json) for r in df.collect()), f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    assert got == [(1, '[{"word":"bar","freq":1,"distance":0}]'), (2, '[{"word":"foo","freq":3,"distance":0},{"word":"fob","freq":5,"distance":1}]'), (3, None), (4, "[]")]
    lines = spark.createDataFrame([(1, "x 1 bra")], "qid long, value string")
    assert answer_batch(lines, d).first().json == '[{"word":"bar","freq":1,"distance":1}]'
