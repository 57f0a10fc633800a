import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from newsgrid.llm.common import scratch
from newsgrid.llm.huffman import Code, Words, code_lengths, read_tokens, write_texts, write_tokens
from newsgrid.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Words(open(PATH).read(), "<u4"), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n,limit", [(1, 3), (2, 3), (5, 3), (8, 3), (300, 9), (300, 18)])
def test_lengths(n, limit):
    counts = np.array([int(1.5 ** min(i, 80)) + i for i in range(n)])
    lengths = code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -lengths) <= 1
    if n > 1:
        assert sum(2.0 ** -lengths) == 1
    import heapq
    heap = [(int(c), i) for i, c in enumerate(counts)]
    if limit == 18 or n == 1:                    # the limit doesn't bind: as good as Huffman's
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            cost += a + b
            heapq.heappush(heap, (a + b, -len(heap)))
        if lengths.max() < limit:
            assert cost == int((counts * lengths).sum()) or n == 1


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_bits(n):
    rng = np.random.default_rng(n)
    used = np.sort(rng.choice(49_000, 3000, replace=False))
    code = Code(used, code_lengths(rng.integers(1, 10 ** 6, 3000) ** 2))
    parts = [rng.choice(used, n), rng.choice(used, 333)]
    packed = [code.pack(p) for p in parts]
    got = code.unpack([p for p, _ in packed], [o for _, o in packed], np.array([n, 333]))
    assert (got == np.concatenate(parts)).all()


def test_words_equal_library():
    own, lib = Words(open(PATH).read(), "<u4"), Tokenizer.from_file(PATH)
    texts = ["", " ", "It's  a\n\ntest", "ÉCOLE über", "a b\x1cc", "́x y", "<|endoftext|> x",
             "don'<|startoftext|>'s", "日本 🙂", "Σας ΣΑΣ", "1234 5", "w" * 3000, "x y\tz",
             "J\u030c j\u030c \u01f0 \u0130I\u0307", "End. END!! a'. é. 'x.' ...a 5. x\u0301. (b). it's. \u00b2.",
             "a\u00a0b. \u2126hm \u00c5 \u1fbe \u0345. \ufb01.", "aa\u1100\u1161. \ud55c."]
    out, counts = own.encode(texts, np.array([7], "<u4").tobytes())
    for text, ids in zip(texts, np.split(out, np.cumsum(counts))):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids + [7], text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abÉéß .,!'st\n\t1İıſǅ|<>$=&-(²\u0301")), st.characters(
    codec="utf-8", max_codepoint=0x2FFF)), max_size=30), max_size=4))
def test_any_words_equal_library(texts):
    own, lib = LIBRARY
    out, counts = own.encode(texts, np.array([7], "<u4").tobytes())
    for text, ids in zip(texts, np.split(out, np.cumsum(counts))):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids + [7], text


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Words(open(public_tokenizers.path("byte_bpe_50k.json")).read(), "<u4")
    changed = json.loads(open(PATH).read())
    changed["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError):
        Words(json.dumps(changed), "<u4")


def test_query(spark, sf):
    lib = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op7_token_file"](spark, sf).collect()}
    start = 0
    for key in sorted(docs):
        ids = np.array(lib.encode(docs[key] or "", add_special_tokens=False).ids + [1], "<u4")
        r = rows.pop(key)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not rows


def test_edges(spark):
    df = spark.createDataFrame([(2, None, "a"), (1, "", "b"), (None, "x y", "c"), (1, "z", "d"),
                                (3, "many " * 100_000, "e")], "doc_id long, text string, ids string")
    path = scratch(spark, "t")
    write_texts(df, PATH, path)
    rows = read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3]
    assert [r.start for r in rows] == [0, 3, 4, 6, 7] and len(rows[-1].ids) == 4 * 100_001
    path = scratch(spark, "t")
    write_texts(df.limit(0), PATH, path)
    assert read_tokens(spark, path).collect() == []
    single = spark.createDataFrame([(1, bytearray(np.full(300, 9, "<u4").tobytes()))],
                                   "doc_id long, ids binary")
    path = scratch(spark, "t")
    write_tokens(single, path)
    assert bytes(read_tokens(spark, path).first().ids) == np.full(300, 9, "<u4").tobytes()
