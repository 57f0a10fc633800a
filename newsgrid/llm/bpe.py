"""Byte-level BPE encoding and decoding (operator 9).

Texts are cut into pieces by a finite automaton over codepoint classes.  A
character's effect on the automaton is a function from states to states; most
are constant, the others are composed by pointer doubling, so the boundaries of
a whole batch come from array operations and no regular expression.  A batch's
different pieces are looked up in a worker's cache; those that are new to it are
merged together, a pair of each a step, and all are dealt back by offsets.

Null and empty texts have no tokens.  Repeated rows are encoded alike.  Only
the columns in ``keep`` are carried; an input column named as an output is not.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from newsgrid.llm.common import lists, slices

# Codepoint classes.
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)

# States: nothing open; a run of letters, numbers, other marks or white space;
# a space that the next piece takes in; a contraction with one or two letters to come.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, LONE_SPACE, ONE_MORE, TWO_MORE = range(8)

# Symbols: what a position shows to the automaton, with its neighbours looked at.
(S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_LAST_SPACE, S_LAST_BLANK,
 S_NEAR, S_QUOTE_ONE, S_QUOTE_TWO) = range(9)

# The endings that the split pattern of the vocabulary knows after an apostrophe.
ONE_LETTER_ENDINGS = "stmd"
TWO_LETTER_ENDINGS = ("re", "ve", "ll")

# White space of the pattern's engine.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
         0x202F, 0x205F, 0x3000]

BATCH_CHARS = 1 << 20
CACHE_PIECES = 200_000
CACHED_LENGTH = 200
WIDTHS = (4, 8, 12, 16, 24, 32)   # bytes of pieces that are merged side by side; longer ones alone
NEVER = np.int32(2 ** 31 - 1)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    kinds = np.fromiter((("LN".find(unicodedata.category(chr(c))[0]) + 1) for c in range(0x110000)),
                        np.uint8, 0x110000)
    table = np.choose(kinds, [OTHER, LETTER, NUMBER]).astype(np.uint8)
    table[WHITE] = BLANK
    table[0x20] = SPACE
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by symbol and state."""
    step = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHER),
                          (S_NEAR, IN_LETTERS)):
        step[symbol] = state
        begins[symbol, [state, LONE_SPACE]] = False
    step[S_NEAR, ONE_MORE], step[S_NEAR, TWO_MORE] = DONE, ONE_MORE
    begins[S_NEAR, [ONE_MORE, TWO_MORE]] = False
    step[S_WHITE] = IN_WHITE
    begins[S_WHITE, IN_WHITE] = False
    step[S_LAST_SPACE], step[S_LAST_BLANK] = LONE_SPACE, DONE
    for symbol, state in ((S_QUOTE_ONE, ONE_MORE), (S_QUOTE_TWO, TWO_MORE)):
        step[symbol] = state
        step[symbol, [IN_OTHER, LONE_SPACE]] = IN_OTHER
        begins[symbol, [IN_OTHER, LONE_SPACE]] = False
    return step, begins


STEP, BEGINS = automaton()
CONSTANT = (STEP == STEP[:, :1]).all(axis=1)


def symbols(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of every position; ``first`` marks where texts begin."""
    n = len(chars)
    kind = classes()[chars]
    inside = np.zeros(n, bool)                    # the next position is of the same text
    inside[:-1] = ~first[1:]
    white = kind >= BLANK
    out = np.choose(kind, [S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_WHITE]).astype(np.uint8)
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & inside[:-1] & ~white[1:]
    out[last & (kind == SPACE)] = S_LAST_SPACE
    out[last & (kind == BLANK)] = S_LAST_BLANK
    quotes = np.flatnonzero(chars == 0x27)
    if len(quotes):
        at = lambda k: np.where(quotes + k < n, chars[np.minimum(quotes + k, n - 1)], 0)
        within = lambda k: inside[np.minimum(quotes + k, n - 1)] & (quotes + k < n)
        a, b = at(1), at(2)
        one = within(0) & np.isin(a, [ord(c) for c in ONE_LETTER_ENDINGS])
        two = within(0) & within(1) & np.any([(a == ord(x)) & (b == ord(y))
                                              for x, y in TWO_LETTER_ENDINGS], axis=0)
        out[quotes[one]] = S_QUOTE_ONE
        out[quotes[two]] = S_QUOTE_TWO
        out[quotes[one] + 1] = S_NEAR
        out[quotes[two] + 1] = S_NEAR
        out[quotes[two] + 2] = S_NEAR
    return out


def piece_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where pieces begin, over texts laid end to end."""
    if not len(chars):
        return np.zeros(0, np.int64)
    symbol = symbols(chars, first)
    after = STEP[symbol, 0]
    fixed = CONSTANT[symbol] | first
    open_at = np.flatnonzero(~fixed)
    if len(open_at):
        row = np.full(len(chars), -1, np.int64)
        row[open_at] = np.arange(len(open_at))
        maps, back = STEP[symbol[open_at]], open_at - 1
        while True:
            left = np.flatnonzero(~fixed[back])
            if not len(left):
                break
            mid = row[back[left]]
            maps[left] = np.take_along_axis(maps[left], maps[mid].astype(np.int64), axis=1)
            back[left] = back[mid]
        after[open_at] = maps[np.arange(len(open_at)), after[back]]
    before = np.zeros(len(chars), np.uint8)
    before[1:] = after[:-1]
    before[first] = DONE
    return np.flatnonzero(BEGINS[symbol, before])


class Codec:
    """Merging and decoding by a rank file's contents."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())
                      if a}
        size = max(self.ranks.values(), default=-1) + 1
        self.vocabulary = [b""] * size
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.lengths = np.fromiter(map(len, self.vocabulary), np.int64, size)
        self.words = pa.array(self.vocabulary, pa.large_binary())
        self.cache: dict[bytes, bytes] = {}
        # Pairs of ids whose bytes in a row are a token, and that token: its id is the pair's rank.
        pairs = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], rank) for t, rank in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs] + [2 ** 63 - 1], np.int64)
        self.merged = np.array([r for _, r in pairs] + [NEVER], np.int32)
        single = np.fromiter((self.ranks.get(bytes([b]), -1) for b in range(256)), np.int64, 256)
        self.single = single.astype(np.int32)
        self.first = self.rank(np.repeat(single, 256), np.tile(single, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair of ids merges into, or NEVER."""
        pair = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], NEVER)

    def merge_side_by_side(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
                           width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, one a row, and how many they are.

        Each step merges the pair of lowest rank, the leftmost of equals, in every row.
        """
        column = np.arange(width)
        held = column < sizes[:, None]
        byte = np.where(held, raw[np.minimum(starts[:, None] + column, len(raw) - 1)], 0)
        ids = np.where(held, self.single[byte], 0).astype(np.int32)
        ranks = np.full(ids.shape, NEVER, np.int32)
        ranks[:, :-1] = np.where(held[:, 1:], self.first[byte[:, :-1], byte[:, 1:]], NEVER)
        sizes = sizes.copy()
        rows, out = np.arange(len(ids)), ids.copy()
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            go = best < NEVER
            if not go.all():
                out[rows[~go]] = ids[~go]
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            sizes[rows] -= 1
            later = column[1:] > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            ids[each, at] = best
            left = sizes[rows]
            inner = at + 1 < left
            ranks[each, at] = NEVER
            ranks[each[inner], at[inner]] = self.rank(best[inner], ids[each[inner], at[inner] + 1])
            inner = at > 0
            ranks[each[inner], at[inner] - 1] = self.rank(ids[each[inner], at[inner] - 1], best[inner])
        return out, sizes

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new pieces, as bytes."""
        out = {p: np.array(self.merge(p), "<i4").tobytes() for p in pieces if len(p) > WIDTHS[-1]}
        rest = [p for p in pieces if len(p) <= WIDTHS[-1]]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        raw = np.frombuffer(b"".join(rest), np.uint8)
        starts = np.cumsum(sizes) - sizes
        least = 0
        for width in WIDTHS:
            of = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if not len(of):
                continue
            ids, n = self.merge_side_by_side(raw, starts[of], sizes[of], width)
            flat = ids[np.arange(width) < n[:, None]].astype("<i4").tobytes()
            ends = (np.cumsum(n) * 4).tolist()
            out.update(zip([rest[i] for i in of.tolist()], [flat[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of different pieces, as bytes; the cache is emptied when full."""
        found = list(map(self.cache.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            learned = self.learn([pieces[i] for i in new])
            if len(self.cache) + len(new) > CACHE_PIECES:
                self.cache.clear()
            for i in new:
                found[i] = learned[pieces[i]]
            self.cache.update((p, ids) for p, ids in learned.items() if len(p) <= CACHED_LENGTH)
        return found

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank, the leftmost of equals, goes first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))               # end of the part that starts here; 0: none does
        before = list(range(-1, n - 1))
        waiting: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = self.ranks.get(piece[i:end[j]])
                if rank is not None:
                    heapq.heappush(waiting, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, each id's first byte within its text, and the number of ids of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = joined.encode()
        first = np.zeros(len(chars), bool)
        begin = np.cumsum(sizes) - sizes
        first[begin[sizes > 0]] = True
        width = (1 + (chars > 0x7F).view(np.uint8) + (chars > 0x7FF).view(np.uint8)
                 + (chars > 0xFFFF).view(np.uint8))
        byte = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        starts = piece_starts(chars, first)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(byte[starts], len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        found = self.look_up(pieces.dictionary.to_pylist())
        of = pieces.indices.to_numpy()
        flat = np.frombuffer(b"".join(found), "<i4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, per_piece = gather(flat, sizes, of)
        bounds = per_piece[np.searchsorted(starts, np.append(begin, len(chars)))]
        counts = np.diff(bounds)
        at = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        return ids, at - np.repeat(byte[begin], counts), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes end to end, and how many each list gives."""
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=ends[1:])
        raw = self.words.take(pa.array(ids)).buffers()[2].to_pybytes()[:ends[-1]] if len(ids) else b""
        return raw, np.diff(ends[np.append(0, np.cumsum(counts))])


def gather(flat: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number ``of`` out of lists laid end to end, again end to end, and where each begins."""
    counts = sizes[of]
    begin = np.zeros(len(of) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    shift = (np.cumsum(sizes) - sizes)[of] - begin[:-1]
    return flat[np.repeat(shift, counts) + np.arange(begin[-1])], begin


def binaries(raw: bytes, counts: np.ndarray) -> pa.Array:
    """A binary column from all bytes end to end and the length of each row's."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts),
                                 [None, pa.py_buffer(ends), pa.py_buffer(raw)])


@lru_cache(maxsize=2)
def codec(ranks: bytes) -> Codec:
    return Codec(ranks)


def bpe_encode(df: DataFrame, ranks_path: str, text: str = "text",
               keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep``, ``ids`` (the tokens of ``text``) and ``offsets`` (each token's first byte).

    With ``decoded`` the ids are decoded again into a column of that name, in the
    same Python workers; ``bpe_decode`` would take a second set of them.
    ``ranks_path`` is a rank file on the driver; its contents, a vocabulary of
    bounded size, are broadcast.
    """
    spark = df.sparkSession
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    carried = df.select(*keep).schema
    schema = T.StructType([*carried, T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("offsets", T.ArrayType(T.IntegerType(), False)),
                           *[T.StructField("decoded", T.BinaryType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, BATCH_CHARS):
                ids, at, counts = own.encode(
                    [t or "" for t in column.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(carried))),
                     lists(ids, counts, pa.int32()), lists(at.astype(np.int32), counts, pa.int32()),
                     *([binaries(*own.decode(ids, counts))] if decoded else [])],
                    names=schema.names)

    return df.select(*keep, df[text].alias("_text_to_encode")).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ranks_path: str, ids: str = "ids",
               keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``, the bytes that the ids in column ``ids`` stand for.

    A null list gives no bytes.  Ids must be of the vocabulary.
    """
    spark = df.sparkSession
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    carried = df.select(*keep).schema
    schema = T.StructType([*carried, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, BATCH_CHARS):
                found = own.decode(column.slice(a, b - a).flatten().to_numpy(), sizes[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(carried))),
                     binaries(*found)], names=schema.names)

    return df.select(*keep, df[ids].alias("_ids_to_decode")).mapInArrow(run, schema)
