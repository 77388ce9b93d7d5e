"""Oracle SQL (DuckDB) of the engine's own queries, written apart from the Spark plans."""

from __future__ import annotations

_DICT = "dict AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY word)"
_BENCH = "bench AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM benchmark) WHERE word <> '')"
_NAMES = "names AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region))"
_QID = "CAST(('0x' || substr(md5({0}), 1, 15)) AS BIGINT)"
_QUERIES = "q AS (SELECT " + _QID.format("word") + " AS qid, substr(word, 1, 2) || substr(word, 2) AS query FROM bench)"

#: Distances of pairs (a, b) of words, row by row over their bytes: `pairs` in, `osa` (a, b, d, least) out.
_OSA = """
r(a, b, x, y, i, p2, p1) AS (
  SELECT a, b, regexp_extract_all(hex(encode(a)), '..'), regexp_extract_all(hex(encode(b)), '..'), 0, CAST(NULL AS BIGINT[]), range(0, strlen(b) + 1) FROM pairs
  UNION ALL
  SELECT a, b, x, y, i + 1, p1, list_transform(range(0, len(y) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda u: e[u + 1] + j - u)))
  FROM (SELECT *, list_concat([CAST(i + 1 AS BIGINT)], list_transform(range(1, len(y) + 1), lambda j: least(p1[j + 1] + 1, p1[j] + CAST(x[i + 1] <> y[j] AS BIGINT),
          CASE WHEN i >= 1 AND j >= 2 AND x[i + 1] = y[j - 1] AND x[i] = y[j] THEN p2[j - 1] + 1 ELSE 1000000 END))) AS e FROM r WHERE i < len(x))
),
osa AS (SELECT a, b, CAST(p1[len(y) + 1] AS INTEGER) AS d, CAST(list_min(p1) AS INTEGER) AS least FROM r WHERE i = len(x))"""


def _fuzzy(k: str, words: str = "dict", queries: str = _QUERIES, most: int = 2) -> str:
    """Common table `hits` (qid, max_distance, query, word, freq, distance): the unrestricted distance bounds the restricted one from below, the plain one from above; where they differ, the table decides."""
    return f"""near AS MATERIALIZED (SELECT q.qid, q.query, {k} AS k, w.word, w.freq, damerau_levenshtein(q.query, w.word) AS dl, levenshtein(q.query, w.word) AS lev
  FROM q JOIN {words} w ON strlen(w.word) BETWEEN strlen(q.query) - ({k}) AND strlen(q.query) + ({k}) WHERE damerau_levenshtein(q.query, w.word) <= {k}),
pairs AS (SELECT DISTINCT query AS a, word AS b FROM near WHERE dl >= 2 AND dl < lev),{_OSA},
hits AS (SELECT qid, CAST(k AS INTEGER) AS max_distance, query, word, freq, CAST(coalesce(d, dl) AS INTEGER) AS distance FROM near LEFT JOIN osa ON query = a AND word = b WHERE coalesce(d, dl) <= k)"""


def _one_less(columns: str, table: str, word: str = "query") -> str:
    """Rows of a table with x, the hexadecimal bytes of a word as they are and without each one of them."""
    bytes_ = f"hex(encode({word}))"
    return f"SELECT {columns}, {bytes_} AS x FROM {table} UNION ALL SELECT {columns}, substr(h, 1, 2 * i) || substr(h, 2 * i + 3) AS x FROM (SELECT *, {bytes_} AS h, unnest(range(0, strlen({word}))) AS i FROM {table})"


_COLUMNS = "qid, max_distance, query, word, freq, distance"
_JSON = """CASE WHEN count(word) = 0 THEN '[]' ELSE '[' || string_agg('{"word":"' || word || '","freq":' || freq || ',"distance":' || distance || '}', ',' ORDER BY distance, freq DESC, word) || ']' END"""
_ANSWERS = f"SELECT q.qid, {_JSON} AS json FROM q LEFT JOIN hits USING (qid) GROUP BY q.qid"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_TREE = f"""{_DICT},
w AS (SELECT lower(hex(encode(word))) AS h, freq FROM dict),
pre AS (SELECT h, pos, substr(h, 1, 2 * pos) AS prefix FROM (SELECT h, unnest(range(0, len(h) // 2 + 1)) AS pos FROM w)),
every AS (SELECT DISTINCT prefix FROM pre),
kids AS (SELECT substr(prefix, 1, len(prefix) - 2) AS parent, count(*) AS n FROM every WHERE prefix <> '' GROUP BY 1),
path AS (SELECT pre.h, pos, prefix, coalesce(n, 0) AS n, w.freq, coalesce(n, 0) <> 1 OR w.freq IS NOT NULL AS stays FROM pre LEFT JOIN kids ON prefix = parent LEFT JOIN w ON prefix = w.h),
chain AS (SELECT *, pos - coalesce(max(CASE WHEN stays THEN pos END) OVER (PARTITION BY h ORDER BY pos), -1) AS run FROM path),
kept AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY pos) - 1 AS depth FROM chain WHERE stays OR run % 8 = 0),
node AS (SELECT prefix, any_value(n) AS n, any_value(freq) AS freq, min(depth) = 0 AS root FROM kept GROUP BY prefix),
kinds AS (SELECT *, CASE WHEN root OR n > 48 THEN 'node256' WHEN n > 16 THEN 'node48' WHEN n > 4 THEN 'node16' WHEN n > 0 THEN 'node4' ELSE 'node0' END AS kind FROM node),
edge AS (SELECT DISTINCT parent, child, substr(child, len(parent) + 1) AS label FROM (SELECT lag(prefix) OVER (PARTITION BY h ORDER BY pos) AS parent, prefix AS child FROM kept) WHERE parent IS NOT NULL)"""
_LATIN = "array_to_string(list_transform(regexp_extract_all({0}, '..'), lambda z: chr(CAST('0x' || z AS INTEGER))), '')"
_ALL_PAIRS = f"{_NAMES}, pairs AS (SELECT x.word AS a, y.word AS b FROM names x, names y)"

ORACLE = {
    "dictionary_build": f"WITH {_DICT} SELECT word, freq FROM dict",
    "dictionary_dedupe_max": "SELECT word, CAST(max(p_size) AS BIGINT) AS freq FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_size FROM part) GROUP BY word",
    "dictionary_file_parse": "SELECT CASE WHEN p_size % 7 <> 0 THEN replace(p_brand, '#', 'é') END AS word, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS freq, CASE WHEN p_size % 7 = 0 THEN replace(p_brand, '#', 'é') END AS corrupt FROM part",
    "query_line_parse": "SELECT event_id, CAST(user_id % 5 AS INTEGER) AS max_distance, event_type AS word FROM events",
    "bench_query_mix": f"WITH {_DICT} (SELECT 'head' AS part, word FROM dict ORDER BY freq DESC, word LIMIT 2250) UNION ALL (SELECT 'tail' AS part, word FROM dict ORDER BY freq, word DESC LIMIT 750)",
    "exact_lookup_k0": f"WITH {_DICT}, {_BENCH} SELECT {_QID.format('word')} AS qid, 0 AS max_distance, word AS query, word, freq, 0 AS distance FROM bench JOIN dict USING (word)",
    "osa_pairs": _with(_ALL_PAIRS, _OSA) + "SELECT a, b, d AS distance FROM osa",
    "osa_arrow_pairs": _with(_ALL_PAIRS, _OSA) + "SELECT a, b, d AS distance FROM osa",
    "osa_prefixes": _with(_ALL_PAIRS, _OSA) + "SELECT a, b, CAST(i AS INTEGER) AS fed, CAST(p1[len(y) + 1] AS INTEGER) AS distance FROM r",
    "row_min_prune": _with(_ALL_PAIRS, _OSA) + "SELECT a, b, least FROM osa",
    "kernel_dispatch": f"WITH {_DICT} SELECT word, strlen(word) + 50 <= 61 AS fits FROM dict",
    "byte_lengths": f"WITH {_DICT} SELECT word, CAST(strlen(word) AS INTEGER) AS n_bytes, true AS round_trip FROM dict",
    "auto_distances": f"WITH {_DICT} SELECT word, CAST(strlen(word) // 5 + 1 AS INTEGER) AS max_distance FROM dict",
    "fuzzy_k1": _with(_DICT, _BENCH, _QUERIES, _fuzzy("1")) + f"SELECT {_COLUMNS} FROM hits",
    "fuzzy_k2": _with(_DICT, _BENCH, _QUERIES, _fuzzy("2")) + f"SELECT {_COLUMNS} FROM hits",
    "fuzzy_mixed_k": _with(_DICT, _BENCH, _QUERIES, _fuzzy("q.qid % 3")) + f"SELECT {_COLUMNS} FROM hits",
    "fuzzy_k3": _with(_DICT, _BENCH, _QUERIES, _fuzzy("3")) + f"SELECT {_COLUMNS} FROM hits",
    "fuzzy_k3_segments": _with(_DICT, _BENCH, _QUERIES, _fuzzy("3")) + f"SELECT {_COLUMNS} FROM hits",
    "fuzzy_variant_index": _with(_DICT, _BENCH, _QUERIES, _fuzzy("2")) + f"SELECT {_COLUMNS} FROM hits",
    "fuzzy_empty_results": _with(_DICT, _BENCH, _QUERIES, _fuzzy("1")) + "SELECT q.qid, q.query, count(hits.word) AS n FROM q LEFT JOIN hits ON q.qid = hits.qid GROUP BY q.qid, q.query",
    "ranked_suggestions": _with(_DICT, _BENCH, _QUERIES, _fuzzy("1")) + f"SELECT {_COLUMNS}, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, freq DESC, word) AS INTEGER) AS rank FROM hits",
    "json_results_exact": _with(_DICT, _BENCH, _QUERIES, _fuzzy("1")) + _ANSWERS,
    "json_results_valid": _with(_DICT, _BENCH, _QUERIES, _fuzzy("1")) + _ANSWERS,
    "unmatched_words": f"WITH {_DICT}, {_BENCH}, {_QUERIES} SELECT qid, query AS word FROM q WHERE query NOT IN (SELECT word FROM dict)",
    "index_words": f"WITH {_DICT} SELECT count(*) AS words FROM dict",
    "index_max_length": f"WITH {_DICT} SELECT CAST(max(strlen(word)) + 1 AS BIGINT) AS max_length FROM dict",
    "index_information": f"WITH {_TREE} SELECT (SELECT count(*) FROM w) AS words, (SELECT count(*) FROM node) AS nodes, CAST(greatest(1, max(depth)) AS BIGINT) AS height, CAST(max(len(h)) // 2 + 1 AS BIGINT) AS max_length, CAST(max(len(h)) // 2 AS BIGINT) AS longest_word FROM kept",
    "index_node_kinds": f"WITH {_TREE} SELECT kind, count(*) AS n FROM kinds GROUP BY kind",
    "index_bytes": f"WITH {_TREE} SELECT CAST(sum(CASE kind WHEN 'node0' THEN 16 WHEN 'node4' THEN 52 WHEN 'node16' THEN 160 WHEN 'node48' THEN 656 ELSE 2064 END) AS BIGINT) AS bytes FROM kinds",
    "index_edges": f"WITH {_TREE} SELECT parent, child, label FROM edge",
    "index_dot": f"""WITH {_TREE} SELECT 'n' || prefix || ' [label="' || coalesce(CAST(freq AS VARCHAR), '') || '", shape=' || CASE kind WHEN 'node0' THEN 'circle' WHEN 'node4' THEN 'triangle' WHEN 'node16' THEN 'box' WHEN 'node48' THEN 'pentagon' ELSE 'hexagon' END || CASE WHEN freq IS NOT NULL THEN ', color=green, style=filled' ELSE '' END || '];' AS line FROM kinds
        UNION ALL SELECT 'n' || parent || ' -> n' || child || ' [label="' || {_LATIN.format('label')} || '"];' FROM edge""",
    "index_persist_roundtrip": f"WITH {_DICT} SELECT word, freq, {_LATIN.format('hex(encode(word))')} AS wb, CAST(strlen(word) AS INTEGER) AS len FROM dict",
    "results_diff": f"WITH {_BENCH}, {_QUERIES} SELECT qid, 'seeded' AS \"right\" FROM q WHERE qid % 97 = 0",
    "bench_stats_trimmed": "SELECT event_type, median, list_max(list_transform(kept, lambda t: abs(t - median))) AS error FROM (SELECT event_type, kept, kept[len(kept) // 2 + 1] AS median FROM (SELECT event_type, list_sort(list(CAST(floor(value) AS BIGINT)))[3 : count(*) - 2] AS kept FROM events GROUP BY event_type))",
    "stream_search": f"""WITH {_DICT},
turns AS (SELECT (conv_id * 1000 + turn) * 100000 AS first, regexp_extract_all(text, '\\p{{L}}+') AS words FROM conversations),
lines AS (SELECT first + i AS qid, words[i + 1] AS query FROM (SELECT first, words, unnest(range(0, len(words))) AS i FROM turns)),
asked AS (SELECT DISTINCT query FROM lines),
left_out AS (SELECT DISTINCT query, x FROM ({_one_less('query', 'asked')})),
kept_in AS (SELECT DISTINCT word, freq, x FROM ({_one_less('word, freq', 'dict', 'word')})),
hits AS (SELECT DISTINCT query, word, freq, CAST(damerau_levenshtein(query, word) AS INTEGER) AS distance FROM left_out JOIN kept_in USING (x) WHERE damerau_levenshtein(query, word) <= 1),
found AS (SELECT query, {_JSON} AS json FROM asked LEFT JOIN hits USING (query) GROUP BY query)
SELECT qid, json FROM lines JOIN found USING (query)""",
}
