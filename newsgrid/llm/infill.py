"""Fill-in-middle rewriting of documents (operator 13).

A text is cut at two unit boundaries into prefix, middle and suffix.  Where the
boundaries lie is kept as a learned rank index: straight pieces, fitted to all
boundary offsets with a bounded error, predict the byte at which a unit begins,
and a stored residual of one byte corrects the prediction exactly.

Cuts come from the SHA-256 of ``seed:key``: its first four groups of 8 hex
digits are h1 to h4.  The prefix ends after the smaller of h1 and h2 modulo
n + 1 units, the middle after the larger.  A text stays ``plain`` if it is
empty, holds a sentinel, or h3 modulo 100 is ``rate`` or more; else it becomes
``spm`` (suffix first) if h4 modulo 100 is below ``suffix_first``, or ``psm``.

Null texts are empty texts.  A null key is hashed as an empty string.  Rows are
independent: repeated rows give repeated results, an empty table an empty one,
and only the columns in ``keep`` are carried, an input column that is named as
an output is not.  Long texts are indexed in blocks; what is held is the text,
one byte a unit for residuals, and one row a piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SENTINELS = ("<P>", "<S>", "<M>")     # before prefix, suffix and middle
ERROR = 120                           # bytes a piece may be off; residuals are 8-bit
FIRST_STEP = 256                      # points looked at first when a piece is extended
BLOCK_BYTES = 1 << 22
OUTPUTS = ("n", "form", "prefix_units", "middle_units", "output")


def fit_pieces(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[float]]:
    """First ranks and slopes of pieces that pass their first point and miss others by ``error`` at most.

    A piece grows while the cone of slopes that meet all its points is open.
    """
    n, starts, slopes, a = len(offsets), [], [], 0
    while a < n:
        low, high, at, step, end = -np.inf, np.inf, a + 1, FIRST_STEP, n
        while at < n:
            run = np.arange(at - a, min(at + step, n) - a, dtype=np.float64)
            rise = (offsets[at:at + step] - offsets[a]).astype(np.float64)
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            shut = lows > highs
            if shut.any():
                first = int(shut.argmax())
                end = at + first
                if first:
                    low, high = lows[first - 1], highs[first - 1]
                break
            low, high = lows[-1], highs[-1]
            at, step = at + len(run), step * 2
        starts.append(a)
        slopes.append((low + high) / 2 if end > a + 1 else 0.0)
        a = end
    return starts, slopes


class RankIndex:
    """Byte offsets of unit boundaries, by rank: boundary k lies before unit k, the last one at the end."""

    def __init__(self, blocks: Iterator[np.ndarray]):
        starts, bases, slopes, residuals, self.n = [], [], [], [], 0
        for offsets in blocks:
            if not len(offsets):
                continue
            if int(offsets[-1] - offsets[0]) == len(offsets) - 1:      # a byte a unit: one piece, no error
                first, slope = [0], [1.0]
            else:
                first, slope = fit_pieces(offsets)
            first, slope = np.array(first), np.array(slope)
            sizes = np.diff(np.append(first, len(offsets)))
            rank = np.arange(len(offsets)) - np.repeat(first, sizes)
            guess = np.repeat(offsets[first], sizes) + np.rint(np.repeat(slope, sizes) * rank).astype(np.int64)
            residuals.append((offsets - guess).astype(np.int8))
            starts.append(first + self.n)
            bases.append(offsets[first])
            slopes.append(slope)
            self.n += len(offsets)
        self.starts, self.bases, self.slopes = map(np.concatenate, (starts, bases, slopes))
        self.residuals = np.concatenate(residuals)

    def at(self, rank: int) -> int:
        """The byte at which unit ``rank`` begins: predicted, then corrected."""
        piece = int(np.searchsorted(self.starts, rank, "right")) - 1
        guess = int(self.bases[piece]) + int(np.rint(self.slopes[piece] * (rank - int(self.starts[piece]))))
        return guess + int(self.residuals[rank])


def _begins(raw: np.ndarray, a: int, b: int, units: str) -> np.ndarray:
    """Where units begin within bytes a to b."""
    here = raw[a:b]
    if units == "chars":
        return np.flatnonzero((here & 0xC0) != 0x80) + a
    before = np.concatenate([raw[a - 1:a] if a else np.array([0x0A], np.uint8), here[:-1]])
    if units == "lines":
        return np.flatnonzero(before == 0x0A) + a
    white = (here == 0x20) | ((here >= 0x09) & (here <= 0x0D))
    return np.flatnonzero(~white & ((before == 0x20) | ((before >= 0x09) & (before <= 0x0D)))) + a


def unit_index(raw: bytes, units: str = "chars") -> RankIndex:
    """The rank index of a text's bytes, in units of code points, words or lines.

    White space belongs to the word before it; in front of the first word, to that one.
    """
    if units not in ("chars", "words", "lines"):
        raise ValueError("units are chars, words or lines")
    data = np.frombuffer(raw, np.uint8)

    def blocks() -> Iterator[np.ndarray]:
        first = True
        for a in range(0, len(data), BLOCK_BYTES):
            found = _begins(data, a, min(a + BLOCK_BYTES, len(data)), units)
            if first and len(found):
                first, found[0] = False, 0
            yield found
        yield np.array([len(data)])

    return RankIndex(blocks())


def cut(raw: bytes, digest: str, units: str = "chars", sentinels: Sequence[str] = SENTINELS,
        rate: int = 90, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """``n``, ``form``, units of prefix and middle, and the output of one text."""
    marks = [s.encode() for s in sentinels]
    index = unit_index(raw, units)
    n = index.n - 1
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not raw or any(m in raw for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, raw
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y = index.at(a), index.at(b)
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        form, out = "spm", b"".join([s, raw[y:], p, raw[:x], m, raw[x:y]])
    else:
        form, out = "psm", b"".join([p, raw[:x], s, raw[y:], m, raw[x:y]])
    return n, form, a, b - a, out


def infill(df: DataFrame, seed: int = 1, units: str = "chars", sentinels: Sequence[str] = SENTINELS,
           rate: int = 90, suffix_first: int = 20, key: str = "doc_id", text: str = "text",
           keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n`` (units), ``form``, ``prefix_units``, ``middle_units`` and ``output``."""
    if len(set(sentinels)) != 3 or any(s.count("<") != 1 or not s.startswith("<") for s in sentinels):
        raise ValueError("sentinels are three different strings whose only '<' is the first character")
    keep = [c for c in keep if c not in OUTPUTS]
    schema = T.StructType([*df.select(*keep).schema, T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()),
                           T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = batch.column(len(keep)), batch.column(len(keep) + 1)
            made = [cut(t.as_buffer().to_pybytes() if t.is_valid else b"", d.as_py(), units, sentinels,
                        rate, suffix_first) for t, d in zip(texts, digests)]
            n, form, prefix, middle, out = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df[key].cast("string"), F.lit(""))), 256)
    return df.select(*keep, df[text].alias("_text_to_cut"), digest.alias("_digest")).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``output`` was made from.

    A text in ``psm`` or ``spm`` form has no sentinel of its own, and none can
    arise where a part meets one, as '<' occurs in a sentinel only at its start.
    """
    p, s, m = sentinels

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        x, y = F.locate(two, output), F.locate(m, output)
        begin = len(one) + 1
        return (F.substr(output, F.lit(begin), x - begin), F.substr(output, x + len(two), y - x - len(two)),
                F.substr(output, y + len(m)))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
