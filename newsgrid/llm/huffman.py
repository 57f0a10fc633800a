"""Token ids as length-limited canonical Huffman code (operator 7).

A token file is a folder of two Parquet tables.  ``codebook`` has the code
length of every id that occurs; lengths alone fix a canonical code.  ``blocks``
has one row for each independent block: its part and number (documents ascend
by both), the ids of its part before it, its documents and their token counts,
the code bits, and the bit offset of every ``STRIDE``-th id, from which decoding
starts anywhere in the block.

Null and empty texts consist of the end id alone.  Repeated keys keep all their
rows, ordered by their ids; null keys come first.  An empty table gives an
empty file and reads back empty.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsgrid.llm.bpe import binaries, gather
from newsgrid.llm.common import lists, materialise, slices

LIMIT = 18            # longest code; vocabularies have up to 2 ** LIMIT ids
BLOCK_IDS = 1 << 16   # ids after which a block is closed; a document is never split
STRIDE = 128
BATCH_CHARS = 1 << 21
CACHE_WORDS = 300_000
CACHED_LENGTH = 100
GROUP_WORDS = 64
# First UTF-8 bytes of the combining marks U+0300 to U+036F.
COMBINING_LEADS = (b"\xcc", b"\xcd")


# Fixed value: the pattern of the tokenizers that `Words` can take apart.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_shape(definition: str) -> None:
    """Refuse a tokenizer whose ids aren't those of its words between spaces.

    Needed are a normaliser that composes, makes white space spaces and lowers, the pattern
    above, which drops spaces and parts letters and digits from marks, and BPE of such units.
    """
    found = json.loads(definition)
    steps = [s["type"] for s in (found.get("normalizer") or {}).get("normalizers", [])]
    cuts = (found.get("pre_tokenizer") or {}).get("pretokenizers", [])
    units = [c["pattern"].get("Regex") for c in cuts
             if c["type"] == "Split" and c["behavior"] == "Removed" and c["invert"]]
    plain = [c for c in cuts if c["type"] == "ByteLevel" and not c["use_regex"] and not c["add_prefix_space"]]
    if (steps != ["NFC", "Replace", "Lowercase"] or units != [UNITS] or len(plain) != 1 or len(cuts) != 2
            or found["model"]["type"] != "BPE" or not found["model"]["end_of_word_suffix"]):
        raise ValueError("not a tokenizer of lower-cased words whose pattern drops white space")


END = b"\xff"          # in no UTF-8 text
LETTER, DIGIT, MARK, SPACE = 1, 2, 3, 4
KINDS = np.zeros(256, np.uint8)        # of bytes; others, quotes and the marks of special tokens never part words
KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
KINDS[list(b"0123456789")] = DIGIT
KINDS[list(b".,!?;:#$%&*()[]{}-_+=/\\@~^`\"")] = MARK
KINDS[0x20] = SPACE
CUTS = np.zeros(25, bool)              # whether the pattern parts two kinds in a row
CUTS[[LETTER * 5 + MARK, MARK * 5 + LETTER]] = True
CUTS[DIGIT * 5:DIGIT * 5 + 5] = True
# Letters below are neither marks nor composed any further.
PLAIN_BELOW = "\u0250"


class Words(dict):
    """Words between spaces to the bytes of their ids, by the tokenizers library.

    Its pattern drops white space and never joins across it, so a text's ids are
    those of its words in a row.  It also parts letters from marks and takes digits
    one by one, so words are cut there.  That is how this kind of tokenizer works,
    and others are refused.
    """

    def __init__(self, definition: str, kind: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        check_shape(definition)
        from tokenizers import normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = kind
        # The same model for words of lower-case letters: nothing to normalise, spaces part them.
        self.plain = Tokenizer.from_str(definition)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, end = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)     # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith(end)]] = True

    def split(self, text: str) -> bytes:
        """A text's words and END, with a space in front of each."""
        raw = text.encode()
        if not any(lead in raw for lead in COMBINING_LEADS):   # else a mark could compose with a letter's other case
            raw = raw.lower()
        return b" " + raw.replace(b"\n", b" ") + b" " + END

    def learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        plain, odd = [], []
        for i, t in enumerate(texts):
            (plain if t.isalpha() and t == t.lower() and max(t) < PLAIN_BELOW else odd).append(i)
        width = np.dtype(self.kind).itemsize
        groups = [plain[a:a + GROUP_WORDS] for a in range(0, len(plain), GROUP_WORDS)]
        for a in range(0, len(groups), 256):
            many = groups[a:a + 256]
            for group, got in zip(many, self.plain.encode_batch_fast(
                    [" ".join([texts[i] for i in g]) for g in many], add_special_tokens=False)):
                ids = np.array(got.ids, self.kind)
                ends = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
                if len(ends) != len(group):
                    odd += group
                    continue
                raw = ids.tobytes()
                self.update(zip([pieces[i] for i in group], [raw[x:y] for x, y in zip([0, *ends], ends)]))
        for a in range(0, len(odd), 4096):
            got = self.tokenizer.encode_batch([texts[i] for i in odd[a:a + 4096]],
                                              add_special_tokens=False)
            self.update((pieces[i], np.array(e.ids, self.kind).tobytes())
                        for i, e in zip(odd[a:], got))

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of different words."""
        found = list(map(self.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self) > CACHE_WORDS:               # words of this batch that were known stay
            kept = {w: ids for w, ids in zip(words, found)
                    if ids is not None and len(w) <= CACHED_LENGTH}
            self.clear()
            self.update(kept)
        self.learn(list({words[i] for i in new}))
        for i in new:
            found[i] = self[words[i]]
        return found

    def encode(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end`` behind, and how many each has."""
        self[END] = end
        raws = list(map(self.split, texts))
        raw = b"".join(raws)
        kind = KINDS[np.frombuffer(raw, np.uint8)]
        begins = (kind == SPACE) | (kind == DIGIT)
        begins[1:] |= CUTS[kind[:-1] * 5 + kind[1:]]
        starts = np.flatnonzero(begins)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        found = self.look_up([w.lstrip(b" ") for w in words.dictionary.to_pylist()])
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        ids, begin = gather(flat, sizes, words.indices.to_numpy())
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        return ids, np.diff(np.append(0, begin[np.searchsorted(starts, ends)]))


@lru_cache(maxsize=2)
def word_cache(definition: str, kind: str) -> Words:
    return Words(definition, kind)


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id",
             text: str = "text", kind: str = "<u4") -> DataFrame:
    """``key`` and ``ids``: the ids of the whole text and ``end_id`` as numbers of ``kind``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = df.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([df.schema[key], T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(definition.value, kind)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
                ids, counts = words.encode(texts[a:b], end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), binaries(ids.tobytes(), counts * ids.itemsize)],
                    names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def id_counts(tokens: DataFrame, kind: str = "<u4") -> DataFrame:
    """How often every id occurs; each task sums its own before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for a, b in slices(np.array([len(x) for x in batch.column(0).to_pylist()]), 1 << 24):
                ids = np.frombuffer(b"".join(batch.column(0).slice(a, b - a).to_pylist()), kind)
                counts = np.bincount(ids, minlength=len(total))
                counts[:len(total)] += total
                total = counts
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return (tokens.select("ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    row, levels = leaves, []
    for _ in range(limit):
        is_leaf = np.ones(len(row), bool) if not levels else kinds
        levels.append(is_leaf)
        even = row[:len(row) // 2 * 2]
        packages = even[::2] + even[1::2]
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        row, kinds = merged[by], by < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ``ids`` (ascending) with ``lengths``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        size = int(ids.max(initial=-1)) + 1
        self.bits = np.zeros(size, np.int64)
        self.codes = np.zeros(size, np.int64)
        self.bits[ids] = lengths
        room = np.left_shift(1, LIMIT - lengths[order])
        start = np.cumsum(room) - room
        self.codes[ids[order]] = start >> (LIMIT - lengths[order])
        self.table = np.zeros(1 << LIMIT, np.uint32)
        filled = (ids[order].astype(np.uint32) << 5) | lengths[order].astype(np.uint32)
        self.table[:int(room.sum())] = np.repeat(filled, room)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, and the bit offset of every STRIDE-th."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        # A code's bits lie in a 32-bit word and the first LIMIT bits of the next one.
        # Codes don't overlap, so the sums of a word stay below 2 ** 32 and are exact.
        value = self.codes[ids] << (32 + LIMIT - bits - (at & 31))
        word = at >> 5
        n_words = int(ends[-1] >> 5) + 2
        packed = (np.bincount(word, value >> LIMIT, n_words)
                  + np.bincount(word + 1, (value & ((1 << LIMIT) - 1)) << (32 - LIMIT), n_words)
                  ).astype(np.uint32).astype(">u4")
        return packed.tobytes()[:int(ends[-1] + 7) // 8], at[::STRIDE]

    def unpack(self, payloads: list[bytes], offsets: list[np.ndarray],
               sizes: np.ndarray) -> np.ndarray:
        """Ids of all blocks in a row; every checkpoint is a lane of its own."""
        lanes = np.array([len(x) for x in offsets])
        base = np.cumsum([0, *(len(p) + 4 for p in payloads[:-1])]) * 8
        raw = np.frombuffer(b"".join([x for p in payloads for x in (p, b"\0\0\0\0")]) + b"\0" * 8,
                            np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = np.concatenate(offsets).astype(np.int64) + np.repeat(base, lanes)
        out = np.empty((len(at), STRIDE), np.uint32)
        end = len(window) - 1
        for k in range(STRIDE):
            seen = (window[np.minimum(at >> 3, end)] << (at & 7).astype(np.uint32)) >> (32 - LIMIT)
            entry = self.table[seen]
            out[:, k] = entry >> 5
            at += entry & 31
        full = np.full(len(at), STRIDE)
        full[np.cumsum(lanes)[lanes > 0] - 1] = ((sizes - 1) % STRIDE + 1)[lanes > 0]
        return out[np.arange(STRIDE) < full[:, None]]


def load_code(spark: SparkSession, path: str):
    """The codebook of a token file, broadcast; it has a row for each id of the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()
    return spark.sparkContext.broadcast(Code(np.array([r.id for r in rows], np.int64),
                                             np.array([r.length for r in rows], np.int64)))


def write_tokens(tokens: DataFrame, path: str, key: str = "doc_id", kind: str = "<u4") -> None:
    """Write ``tokens`` (``key``, ``ids`` of ``kind``) as a token file in ascending order of ``key``."""
    spark = tokens.sparkSession
    width = np.dtype(kind).itemsize
    counted = id_counts(tokens, kind).orderBy("id").collect()     # bounded by the vocabulary
    lengths = code_lengths(np.array([r.n for r in counted], np.int64))
    spark.createDataFrame([(r.id, int(n)) for r, n in zip(counted, lengths)],
                          "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    code = load_code(spark, path)
    key_type = tokens.schema[key].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(key_type)),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("checkpoints", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, held, held_ids = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, first, held, held_ids
            raw = [x for _, x in held]
            payload, offsets = code.value.pack(np.frombuffer(b"".join(raw), kind))
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first]),
                pa.array([held_ids]), pa.array([[k for k, _ in held]], keys),
                lists(np.array([len(x) // width for x in raw], np.int32), np.array([len(raw)]),
                      pa.int32()),
                lists(offsets, np.array([len(offsets)]), pa.int64()),
                pa.array([payload], pa.binary())], names=schema.names)
            block, first, held, held_ids = block + 1, first + held_ids, [], 0
            return out

        for batch in batches:
            keys = pa.list_(batch.schema.field(0).type)
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(pair)
                held_ids += len(pair[1]) // width
                if held_ids >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    (tokens.select(key, "ids").repartitionByRange(key).sortWithinPartitions(key, "ids")
     .mapInArrow(run, schema).write.parquet(f"{path}/blocks"))


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all rows before) and ``ids`` (little-endian unsigned 32-bit)."""
    code = load_code(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in totals:                              # one row a part of the file
        starts.append((r.part, total))
        total += r.n
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    schema = T.StructType([
        T.StructField(key, blocks.schema["keys"].dataType.elementType),
        T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n_ids, keys, counts, offsets, payload = batch.columns
            sizes = n_ids.to_numpy()
            for a, b in slices(sizes, 1 << 21):
                cut = slice(a, b)
                per_doc = counts.slice(a, b - a).flatten().to_numpy().astype(np.int64)
                per_block = counts.slice(a, b - a).value_lengths().to_numpy(zero_copy_only=False)
                ids = code.value.unpack(payload.slice(a, b - a).to_pylist(),
                                        [np.asarray(x.values) for x in offsets.slice(a, b - a)],
                                        sizes[cut])
                ends = np.cumsum(per_doc)
                shift = first.to_numpy()[cut] - (np.cumsum(sizes[cut]) - sizes[cut])
                limits = np.zeros(len(per_doc) + 1, np.int32)
                limits[1:] = ends * 4
                raw = pa.Array.from_buffers(
                    pa.binary(), len(per_doc),
                    [None, pa.py_buffer(limits), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a).flatten(),
                     pa.array(ends - per_doc + np.repeat(shift, per_block)), raw],
                    names=schema.names)

    return (blocks.join(base, "part")
            .select((F.col("first") + F.col("base")).alias("first"), "n_ids", "keys", "counts",
                    "checkpoints", "payload")
            .mapInArrow(run, schema))


def write_texts(df: DataFrame, tokenizer_path: str, path: str, end_id: int = 1,
                key: str = "doc_id", text: str = "text") -> None:
    """Tokenise whole texts and write them as a token file."""
    from tokenizers import Tokenizer
    kind = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 > end_id else "<u4"
    tokens = materialise(tokenize(df, tokenizer_path, end_id, key, text, kind), "tokens")
    write_tokens(tokens, path, key, kind)
