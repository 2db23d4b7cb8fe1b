"""Byte-level BPE: boundaries by automaton scans over code points, cached pair merging.

The pre-tokenisation pattern is that of the public byte-level vocabularies: contractions,
runs of letters, of numbers and of other characters (each with an optional space in
front) and runs of white space. No regex runs here. Instead

1. a lookup table gives each code point its class (letter, number, space, other white
   space, apostrophe, other); vector comparisons with the next characters mark
   apostrophes that could begin a contraction and white space that ends a run;
2. each resulting symbol is a function from the automaton's states to its states. The
   functions form a finite monoid, so they are numbered and composed by one table
   lookup. A blocked scan composes them: all blocks step in parallel, block totals are
   scanned, and the second pass gives the state at each character;
3. state and symbol tell whether a match begins at a character.

The slices between boundaries go through a cache to pair merging by rank. Byte offsets
of the tokens are kept, and decoding places each token's bytes at its offset.

Cases: a null text counts as empty and has no tokens (both digests are those of no
bytes); a null doc_id and repeated rows are kept as they are; an empty table gives an
empty result; columns other than doc_id and text are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Pieces kept by a Python worker, and the longest that is kept.
CACHE_PIECES, CACHE_CHARS = 200_000, 48
#: Characters scanned at once.
SCAN_CHARS = 1 << 20

# ------------------------------------------------------------ classes and automaton

LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(6)
# Symbols: the classes, then what lookahead adds to them.
QUOTE_2 = 6  # apostrophe followed by s, t, m or d
QUOTE_3 = 7  # apostrophe followed by re, ve or ll
SPACE_END = 8  # space whose next character is not white space
BLANK_END = 9  # other white space likewise
STOP = 10  # end of a text
# States: what the last match holds so far.
AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, OPEN, LEFT_1, LEFT_2 = range(8)
# OPEN: a space that may stand in front of a run. LEFT_k: k more letters of a contraction.


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a match begins at this symbol)."""
    if symbol == STOP:
        return AT_START, True
    if state == LEFT_2:
        return LEFT_1, False
    if state == LEFT_1:
        return AT_START, False
    if symbol in (QUOTE, QUOTE_2, QUOTE_3):
        if state in (IN_OTHERS, OPEN):
            return IN_OTHERS, False
        return {QUOTE: IN_OTHERS, QUOTE_2: LEFT_1, QUOTE_3: LEFT_2}[symbol], True
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
        return run, state not in (run, OPEN)
    if symbol == SPACE_END:
        return OPEN, True  # also within a white-space run: the run gives its last space up
    if symbol == BLANK_END:
        return AT_START, True  # the run gives its last character up; alone it is a match
    return IN_BLANKS, state != IN_BLANKS


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbered functions: of each symbol, composition, value at AT_START, and beginnings."""
    generators = [tuple(_step(s, c)[0] for s in range(8)) for c in range(11)]
    number = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    compose = np.array([[number[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint16)
    begins = np.array([[_step(s, c)[1] for c in range(11)] for s in range(8)])
    return np.array([number[g] for g in generators], np.uint16), compose, np.array([f[AT_START] for f in queue], np.uint8), begins


SYMBOL_FUNCTION, COMPOSE, FROM_START, BEGINS = _monoid()


# First and last code points of the letters and numbers that the regex
# library knows but that Unicode 16, which the reference encoder follows, doesn't assign.
LATER_THAN_UNICODE_16 = """
558 558, 58b 58c, 88f 88f, c5c c5c, cdc cdc, 208f 208f, 209d 209f, a7ce a7cf, a7d2 a7d2, a7d4 a7d4, a7dd a7dd, a7e2 a7e2,
a7f1 a7f1, ab6c ab6d, 107bb 107bf, 10940 10959, 10ec5 10ec7, 10ed9 10eee, 11b0a 11b0a, 11db0 11ddb, 11de0 11de9,
11df1 11df1, 1246f 1246f, 12475 1247f, 12550 12686, 16ea0 16eb8, 16ebb 16ed3, 16ff2 16ff6, 187f8 187ff, 18cd6 18cda,
18d09 18d20, 18d80 18df2, 18e00 19191, 191a0 191d2, 1b123 1b128, 1b168 1b168, 1d6a6 1d6a6, 1df1f 1df24, 1df2b 1df81,
1df90 1df96, 1dfcd 1dfff, 1e6c0 1e6de, 1e6e0 1e6e2, 1e6e4 1e6e5, 1e6e7 1e6ed, 1e6f0 1e6f4, 1e6fe 1e6ff, 2b73a 2b73f,
2b81e 2b81e, 2cea2 2cead, 323b0 33479, 3d000 3fc3f
"""


def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    for first, last in (x.split() for x in LATER_THAN_UNICODE_16.split(",")):
        table[int(first, 16) : int(last, 16) + 1] = OTHER
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _table:
        _table.append(_classes())
    return _table[0]


def boundaries(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Starts of all matches in ``points``, code points of texts that each end in a stop.

    ``stops`` holds the places of the stops (any code point), in order; they are among
    the result, so consecutive starts that don't cross a stop bound one match. Long input is scanned in
    pieces of ``SCAN_CHARS`` that hand the composition of all before them on, so scratch space is bounded.
    """
    found, before = [], 0
    for at in range(0, len(points), SCAN_CHARS):
        n = min(SCAN_CHARS, len(points) - at)
        first, last = np.searchsorted(stops, (at, at + n + 2))
        starts, before = _scan(points[at : at + n + 2], stops[first:last] - at, n, before)
        found.append(starts + at)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _scan(points: np.ndarray, stops: np.ndarray, n: int, before: int) -> tuple[np.ndarray, int]:
    """Starts in the first ``n`` of ``points`` (up to two more are looked at), and the function of all so far."""
    kinds = class_table()[points]
    kinds[stops] = STOP
    symbols = kinds.copy()
    after = np.append(kinds[1:], STOP)
    blank_next = (after == SPACE) | (after == BLANK) | (after == STOP)
    symbols[(kinds == SPACE) & ~blank_next] = SPACE_END
    symbols[(kinds == BLANK) & ~blank_next] = BLANK_END
    quotes = np.flatnonzero(kinds == QUOTE)
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        last = np.append(kinds, [STOP, STOP])[quotes + 1] == STOP
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~last
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~last
        long &= np.append(kinds, [STOP, STOP])[quotes + 2] != STOP
        symbols[quotes[short]] = QUOTE_2
        symbols[quotes[long]] = QUOTE_3
    symbols = symbols[:n]
    width = max(1, int(np.sqrt(n) / 4))
    blocks = -(-n // width)
    grid = np.full(blocks * width, STOP, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)  # step k of all blocks is one row
    functions = SYMBOL_FUNCTION[grid]
    functions[n - (blocks - 1) * width :, -1] = 0  # what fills the last block changes no state
    prefix = np.empty((width, blocks), np.uint16)  # composition of what stands before, in the block
    total = np.zeros(blocks, np.uint16)
    for k in range(width):
        prefix[k] = total
        total = COMPOSE[total, functions[k]]
    carry = np.zeros(blocks, np.uint16)
    for b in range(blocks):
        carry[b] = before
        before = COMPOSE[before, total[b]]
    states = FROM_START[COMPOSE[carry[None, :], prefix]]
    return np.flatnonzero(BEGINS[states, grid].T.reshape(-1)[:n]), int(before)


# ------------------------------------------------------------ pair merging


class Merger:
    """Token ids of pieces by merge ranks, through a bounded cache."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        by_id = sorted((i, t) for t, i in self.ranks.items())
        size = by_id[-1][0] + 1
        lengths = np.zeros(size, np.int64)
        for i, t in by_id:
            lengths[i] = len(t)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        merger = self

        class Pieces(dict):
            def __missing__(self, piece):
                ids = np.array(merger.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= CACHE_CHARS:
                    if len(self) >= CACHE_PIECES:
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: itself if it is a token, else lowest rank first, leftmost on ties."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 100:
            return self._merge_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 60)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list: a piece may be a whole long text."""
        ranks, n = self.ranks, len(piece)
        following, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            nxt = following[k]
            if not alive[k] or nxt >= n or end[nxt] != stop:
                continue
            end[k], following[k], alive[nxt] = stop, following[nxt], False
            if following[k] < n:
                before[following[k]] = k
                if (r := ranks.get(piece[k : end[following[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[following[k]]))
            if before[k] >= 0 and (r := ranks.get(piece[before[k] : stop])) is not None:
                heapq.heappush(heap, (r, before[k], stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : end[k]]])
            k = following[k]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text; a run of texts shares one scan."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size < SCAN_CHARS or upto == at):
                size += len(texts[upto])
                upto += 1
            out += self._encode(texts[at:upto])
            at = upto
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = boundaries(points, stops)
        ends = np.append(starts[1:], len(points))
        cuts = np.searchsorted(starts, stops)
        get, some = self.pieces.__getitem__, max(1, SCAN_CHARS // 8)
        out, first = [], 0
        for cut in cuts.tolist():
            runs = (slice(k, min(k + some, cut)) for k in range(first, cut, some))
            ids = b"".join([b"".join([get(joined[a:b]) for a, b in zip(starts[run].tolist(), ends[run].tolist())]) for run in runs])
            out.append(np.frombuffer(ids, "<u4"))
            first = cut + 1  # the stop itself is no piece
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded bytes, and the end."""
        return np.append(0, np.cumsum(self.lengths[ids]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Each token's bytes placed at its offset."""
        if not len(ids):
            return b""
        shift = np.repeat(self.starts[ids] - offsets[:-1], np.diff(offsets))
        return self.bytes[np.arange(offsets[-1]) + shift].tobytes()


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One merger, with its cache, for each Python worker."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


# ------------------------------------------------------------ Spark jobs


def _slices(batch, rows: int):
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, ranks: str, offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and with ``offsets`` the byte offset of each token. Narrow: no shuffle."""

    def encode(batches):
        m = merger(ranks)
        for batch in batches:
            for doc_ids, texts in _slices(batch, 256):
                ids = m.encode(texts)
                columns = [doc_ids, pa.array([i.astype("<i4") for i in ids], pa.list_(pa.int32()))]
                if offsets:
                    columns.append(pa.array([m.offsets(i)[:-1] for i in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"][: len(columns)])

    schema = "doc_id long, ids array<int>" + (", offsets array<long>" if offsets else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, decoded binary from (doc_id, ids): the exact bytes of the text."""

    def decode(batches):
        m = merger(ranks)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = np.asarray(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], np.int64)
                out.append(m.decode(ids, m.offsets(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, ranks: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with_ids: ids, of every whole text, in one narrow pass."""

    def digest(batches):
        m = merger(ranks)
        for batch in batches:
            for doc_ids, texts in _slices(batch, 256):
                rows = m.encode(texts)
                decoded = [hashlib.sha256(m.decode(i, m.offsets(i))).hexdigest() for i in rows]
                columns = [doc_ids, pa.array([len(i) for i in rows], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in rows]), pa.array(decoded)]
                if with_ids:
                    columns.append(pa.array([i.astype("<i4") for i in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        common.release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document encoded and decoded again."""
    import public_tokenizers

    return digest_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
