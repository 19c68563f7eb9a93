"""Byte-level BPE encoding and decoding in array operations.

Text is cut into pieces without a regular expression. Each code point becomes one of nine symbols
(its class and what follows it); each symbol is a function from the state before it to the state after
it. Composing functions is associative, so the text is laid out in rows, the functions of all rows are
composed side by side, the short list of row functions is chained, and a second sweep reads off the
states and with them the places where pieces begin. Pieces are byte slices; a cache maps a slice to its
ids, a miss runs the pair merges. Offsets of tokens are the running sums of their byte lengths.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import tidied

LETTER, NUMBER, OTHER, BLANK_INSIDE, SPACE_BEFORE, BLANK_ALONE, SHORT, LONG, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINING, ONE_LEFT, TWO_LEFT = range(8)
SEPARATOR = 0x110000
ROW = 256
CHARS_PER_ROUND = 1 << 20
CACHED_BYTES = 48
CACHED_PIECES = 100_000
HEAP_FROM = 96

# Letters and numbers that younger Unicode tables have and those of the tokenizer library
# (Unicode 16) do not; there they are neither letter nor number.
YOUNGER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", both indexed by ``symbol * 8 + state before``."""
    after = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        after[symbol] = inside
        begins[symbol, [inside, JOINING]] = False
    after[LETTER, TWO_LEFT], after[LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        after[symbol] = left
        after[symbol, [IN_OTHERS, JOINING]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, JOINING]] = False
    after[BLANK_INSIDE] = IN_BLANKS
    begins[BLANK_INSIDE, IN_BLANKS] = False
    after[SPACE_BEFORE] = JOINING
    after[BLANK_ALONE] = after[END] = FRESH
    return after.ravel(), begins.ravel()


AFTER, BEGINS = _machine()


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Letter, number, blank (as BLANK_ALONE) or other for every code point."""
    import regex

    points = np.r_[0:0xD800, 0xE000:SEPARATOR]
    everything = points.astype("<u4").tobytes().decode("utf-32-le")
    classes = np.full(SEPARATOR + 1, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK_ALONE)):
        for run in regex.finditer(pattern, everything):
            classes[points[run.start() : run.end()]] = value
    for first, last in YOUNGER:
        classes[first : last + 1] = OTHER
    classes[SEPARATOR] = END
    return classes


def symbols_of(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``points`` ends with a separator."""
    symbols = code_point_classes()[points]
    follows = np.append(symbols[1:], np.uint8(END))
    blank = symbols == BLANK_ALONE
    before_text = follows < BLANK_INSIDE
    inside = blank & ~before_text
    joins = blank & before_text & (points == 0x20)
    # an apostrophe has at least a separator after it, and what follows it is two places on at most
    at = np.flatnonzero(points[:-2] == 0x27)
    one, two = points[at + 1], points[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    symbols[at[short]] = SHORT
    symbols[at[long]] = LONG
    symbols[inside] = BLANK_INSIDE
    symbols[joins] = SPACE_BEFORE
    return symbols


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Places in ``points`` where a piece begins, separators included."""
    symbols = symbols_of(points)
    n = len(symbols)
    rows = -(-n // ROW)
    laid = np.full(rows * ROW, END, np.uint8)
    laid[:n] = symbols
    laid = np.ascontiguousarray(laid.reshape(rows, ROW).T) * np.uint8(8)
    function = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for column in laid:
        function = AFTER.take(function + column)
    entry = np.empty(rows, np.uint8)
    state = FRESH
    for row, into in enumerate(function.T.tolist()):
        entry[row] = state
        state = into[state]
    starts = np.empty((ROW, rows), bool)
    states = entry
    for place, column in enumerate(laid):
        key = states + column
        starts[place] = BEGINS.take(key)
        states = AFTER.take(key)
    return np.flatnonzero(starts.T.ravel()[:n])


class Merger(dict):
    """Piece to its ids as packed bytes; unseen pieces are merged and, when short, kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}

    def __missing__(self, piece: bytes) -> bytes:
        whole = self.packed.get(piece)
        if whole is None:
            parts = merge_long(piece, self.ranks) if len(piece) > HEAP_FROM else merge_short(piece, self.ranks)
            packed = self.packed
            whole = b"".join([packed[p] for p in parts])
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = whole
        return whole


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, the leftmost first, until no pair has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    get = ranks.get
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges with a heap of pairs and linked parts, for pieces of any length."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    alive = bytearray(b"\x01" * n)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    parts, i = [], 0
    while i < n:
        parts.append(piece[i : end[i]])
        i = end[i]
    return parts


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger = Merger(ranks)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.append(0, np.cumsum(self.lengths))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        begin = 0
        while begin < len(texts):
            stop, chars = begin, 0
            while stop < len(texts) and (stop == begin or chars + len(texts[stop]) < CHARS_PER_ROUND):
                chars += len(texts[stop])
                stop += 1
            yield from self._encode_round(texts[begin:stop])
            begin = stop

    def _encode_round(self, texts: list[str]) -> Iterator[bytes]:
        gap = SEPARATOR.to_bytes(4, "little")
        points = np.frombuffer(b"".join([t.encode("utf-32-le") + gap for t in texts]), "<u4")
        data = "".join(texts).encode()
        ends = np.flatnonzero(points == SEPARATOR)
        starts = piece_starts(points)
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        width[ends] = 0
        at = np.append(0, np.cumsum(width, dtype=np.int64))
        first = np.searchsorted(starts, np.append(0, ends[:-1] + 1)).tolist()
        last = np.searchsorted(starts, ends).tolist()
        offsets = at[starts].tolist()
        merger = self.merger
        for lo, hi in zip(first, last):
            # the separator is a piece too, so a piece always ends where the next begins
            yield b"".join([merger[data[a:b]] for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; an id outside the table raises ``IndexError``."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(self.places[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the text."""
        return np.cumsum(self.lengths[ids]) - self.lengths[ids]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def _shared_ranks(docs: DataFrame, path: str):
    """The rank file, a vocabulary of fixed size (under 1 MB here), for all executors."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, offsets array<int>`` for the whole text of every row.

    ``path`` is a rank file. A null text counts as empty and gives empty arrays; other columns are not
    read; repeated rows give repeated results; an empty table gives none.
    """
    ranks = _shared_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(ranks.value))  # the task's own: no worker keeps its cache
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(part.column("text").to_pylist())]
                offsets = [codec.offsets(x).astype(np.int32) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))],
                    ["doc_id", "ids", "offsets"],
                )

    return _texts(docs).mapInArrow(tidied(run), "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, data binary`` from ``doc_id, ids``; null ids count as none."""
    ranks = _shared_ranks(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(ranks.value))  # the task's own: no worker keeps its cache
        for batch in batches:
            data = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidied(run), "doc_id long, data binary")


def token_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded from the ids.

    With ``with_ids`` the ids come along as ``ids array<int>``. Null, repeated and empty input as in
    :func:`encode_documents`.
    """
    ranks = _shared_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(ranks.value))  # the task's own: no worker keeps its cache
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = list(codec.encode(part.column("text").to_pylist()))
                ids = [np.frombuffer(p, "<u4") for p in packed]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _texts(docs).mapInArrow(tidied(run), schema + (", ids array<int>" if with_ids else ""))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
