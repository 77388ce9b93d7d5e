"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is vectorised. Each code point becomes a symbol (its class, with up to two code points of look-ahead
folded in), each symbol is a transition function of a small automaton, and the automaton's states come from an
associative scan: functions are numbered within their finite monoid, rows of a matrix of symbols are composed column by
column, the rows' totals are chained, and a second pass yields the state before every code point. A token starts where
the table of (state, symbol) says so. The slices feed a cache of merged pieces; byte offsets are kept, so that any span
of ids can be decoded on its own.

Defined results: null text counts as empty; empty texts have no ids; bytes that are no UTF-8 are replaced by U+FFFD
before encoding; repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispark.llm import common

# Classes of code points and the symbols made of them.
LETTER, NUMBER, SPACE, OTHER_WS, OTHER, APOSTROPHE, END = range(7)
SYM_L, SYM_N, SYM_O, SP_MORE, SP_LAST, WS_MORE, WS_LAST, APOS_1, APOS_2, RESET = range(10)
# States: what the token read so far is. C1 and C2 are contractions with that many letters to come, CE is a whole one.
BOS, IN_L, IN_N, IN_O, SP, WS, C1, C2, CE = range(9)

#: White_Space of the Unicode Character Database, which is what \s stands for in the pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that a worker's cache holds before it is started anew.
CACHE_PIECES = 300_000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, from the general categories; one more entry stands for the end of a document."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = OTHER_WS
    table[0x20] = SPACE
    table[0x27] = APOSTROPHE
    return np.append(table, np.uint8(END))


def _step(state: int, sym: int) -> tuple[int, bool]:
    """The automaton: next state, and whether a token starts at this symbol."""
    if sym == RESET:
        return BOS, True
    if sym in (SP_MORE, SP_LAST, WS_MORE, WS_LAST):
        more = state in (SP, WS)
        return (SP if sym in (SP_MORE, SP_LAST) else WS), not more or sym in (SP_LAST, WS_LAST)
    if sym in (APOS_1, APOS_2):
        if state in (SP, IN_O):  # joins what is open; a contraction starts only where a token does
            return IN_O, False
        return (C1 if sym == APOS_1 else C2), True
    if sym == SYM_L and state == C2:
        return C1, False
    if sym == SYM_L and state == C1:
        return CE, False
    own = {SYM_L: IN_L, SYM_N: IN_N, SYM_O: IN_O}[sym]
    return own, state not in (SP, own)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, product of two elements (first a, then b), action on states, starts by (state, symbol)."""
    found: dict[tuple[int, ...], int] = {tuple(range(9)): 0}
    symbols = []
    for sym in range(10):
        f = tuple(_step(s, sym)[0] for s in range(9))
        symbols.append(found.setdefault(f, len(found)))
    grown = True
    while grown:
        grown = False
        for a in list(found):
            for b in list(found):
                if (c := tuple(b[a[s]] for s in range(9))) not in found:
                    found[c] = len(found)
                    grown = True
    items = list(found)
    product = np.array([[found[tuple(b[a[s]] for s in range(9))] for b in items] for a in items], np.uint8)
    starts = np.array([[_step(s, sym)[1] for sym in range(10)] for s in range(9)])
    return np.array(symbols, np.uint8), product, np.array(items, np.uint8), starts


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol: an associative scan over the symbols' transition functions."""
    element, product, action, _ = monoid()
    n = len(symbols)
    width = max(64, int(n**0.5))
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)  # element 0 is the identity
    padded[:n] = element[symbols]
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    size = np.uint16(len(product))
    flat_product, flat_action = product.ravel(), action.ravel()
    total = columns[0]
    for column in columns[1:]:
        total = flat_product[total * size + column]
    state, first = BOS, np.empty(rows, np.uint8)
    for i, t in enumerate(total.tolist()):
        first[i] = state
        state = action[t][state]
    out = np.empty((width, rows), np.uint8)
    now = first
    for i, column in enumerate(columns):
        out[i] = now
        now = flat_action[column * np.uint16(9) + now]
    return out.T.ravel()[:n]


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Symbols of code points; 0x110000 marks the end of a document."""
    kind = class_table()[codes]
    after = np.append(kind[1:], END)
    spaces = (kind == SPACE) | (kind == OTHER_WS)
    last = spaces & (after <= OTHER + 1) & (after != SPACE) & (after != OTHER_WS)
    out = np.array([SYM_L, SYM_N, SP_MORE, WS_MORE, SYM_O, SYM_O, RESET], np.uint8)[kind]
    out[last] += 1
    at = np.flatnonzero(kind == APOSTROPHE)
    if len(at):
        ahead = np.concatenate([codes, np.full(2, 0x110000, codes.dtype)])
        one, two = ahead[at + 1], ahead[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS_1
        both = one.astype(np.int64) << 21 | two
        out[at[np.isin(both, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = APOS_2
    return out


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Places where tokens start; the end marks count as tokens of their own."""
    symbols = symbols_of(codes)
    return np.flatnonzero(monoid()[3][states_before(symbols), symbols])


def split(text: str) -> list[str]:
    """Pre-tokens of one text."""
    if not text:
        return []
    at = boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()
    return [text[i:j] for i, j in zip(at, [*at[1:], len(text)], strict=True)]


class Ranks:
    """The vocabulary of a rank file, with its bytes laid end to end for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]
        self.ranks = dict(pairs)
        size = max(r for _, r in pairs) + 1
        pieces = [b""] * size
        for piece, rank in pairs:
            pieces[rank] = piece
        self.lengths = np.fromiter(map(len, pieces), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache = common.Cache(CACHE_PIECES)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, is joined until none is in the vocabulary."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 400:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        near = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == 1 << 60:
                break
            i = near.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long pieces, by a heap over a linked list: n log n."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and where the bytes of each id start."""
        lengths = self.lengths[ids]
        return common.spread(self.bytes, self.offsets[ids], lengths), np.cumsum(lengths) - lengths


@lru_cache(2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def encode_texts(ranks: Ranks, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the number of ids of each."""
    joined, codes, ends = common.code_points(texts)
    codes = codes.copy()
    codes[ends] = 0x110000
    at = boundaries(codes)
    marks = np.searchsorted(at, ends)  # the end marks among the tokens
    keep = np.ones(len(at), bool)
    keep[marks] = False
    starts, stops = at[keep], np.append(at[1:], len(codes))[keep]
    slices = lambda new: zip(starts[new].tolist(), stops[new].tolist(), strict=True)
    merged = lambda new: common.end_to_end([ranks.merge(joined[i:j].encode("utf-8", "surrogatepass")) for i, j in slices(new)])
    ids, counts = ranks.cache.take(common.slice_hashes(codes, starts, stops - starts), merged)
    bounds = np.concatenate([[0], np.cumsum(counts)])[marks - np.arange(len(marks))]
    return ids, np.diff(bounds, prepend=0)


def shas(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """SHA-256 of each stretch of the values' bytes."""
    view = memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else memoryview(b"")
    return pa.array([hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", with_ids: bool = True, with_offsets: bool = False, keep_text: bool = True) -> DataFrame:
    """df with n_tokens and the digests of ids and decoded bytes, and as asked for token_ids (array) and byte_offsets (start of each id's bytes).

    Added columns take the place of columns of the same names. A map over rows: nothing is shuffled.
    """
    common.tune(df.sparkSession)
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "") + (", byte_offsets array<long>" if with_offsets else "")

    def start():
        ranks = ranks_of(path)

        def make(texts: list[bytes | None]) -> list[pa.Array]:
            ids, counts = encode_texts(ranks, common.decoded(texts))
            data, at = ranks.decode(ids)
            ends = np.cumsum(counts)
            places = np.append(at, len(data))
            digests = shas(ids.astype("<u4"), 4 * (ends - counts), 4 * ends)
            columns = [pa.array(counts), digests, shas(data, places[ends - counts], places[ends])]
            edges = pa.array(np.append(0, ends), pa.int32())
            if with_ids:
                columns.append(pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32))))
            if with_offsets:
                columns.append(pa.ListArray.from_arrays(edges, pa.array((at - np.repeat(places[ends - counts], counts)).astype(np.int64))))
            return columns

        return make

    return common.added_columns(df, text, ddl, start, keep_text)


def decode_span(ranks: Ranks, ids: np.ndarray, start: int, stop: int) -> bytes:
    """Bytes start..stop of the decoded text, of which only the ids that they touch are decoded."""
    offsets = np.concatenate([[0], np.cumsum(ranks.lengths[ids])])
    i = int(np.searchsorted(offsets, start, side="right")) - 1
    j = int(np.searchsorted(offsets, stop, side="left"))
    return ranks.decode(ids[i:j])[0].tobytes()[start - int(offsets[i]) : stop - int(offsets[i])]


def query(spark, sf_dir: str) -> DataFrame:
    """op5: digests of ids and decoded bytes for every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False, keep_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
