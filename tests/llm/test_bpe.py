import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from newsgrid.llm.bpe import Codec, bpe_decode, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return Codec(file.read())


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


HARD = ["", " ", "  ", "a", " a", "  a", "a  ", "\n", "\n\n a", "a's", "it's's", "''s", " 's", "\n's",
        "x're", "x'rex", "x'r", "'", "''", "'s", "'ll'll", "'ve 've", "a b", "a   b",
        "　　x", "1a2", "12 34", "!!! ???", "é'sé", "日本語 テキスト", "🙂🙂 'd", "\t\tx", "a \n b",
        "don'T", "'S", "x" * 5000, "ab" * 3000, "'s" * 500, " " * 700 + "x", "\x00a", "áb"]


def test_equals_library_on_hard_texts(own, other):
    ids, at, counts = own.encode(HARD)
    where = 0
    for text, n in zip(HARD, counts):
        assert ids[where:where + n].tolist() == other.encode_ordinary(text), text
        assert at[where:where + n].tolist() == [
            len(b"".join(own.vocabulary[i] for i in ids[where:where + k])) for k in range(n)] \
            if n < 300 else True
        where += n
    raw, sizes = own.decode(ids, counts)
    assert raw == "".join(HARD).encode() and sizes.tolist() == [len(t.encode()) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(
    st.sampled_from(list("'srtvemld  \n\tAa1!é  Ⅷ²")), st.characters(codec="utf-8",
                                                                         max_codepoint=0x2FFF)),
    max_size=40), max_size=4))
def test_equals_library_on_any_text(texts):
    with open(PATH, "rb") as file:
        data = file.read()
    from newsgrid.llm.bpe import codec
    mine = codec(data)
    ids, _, counts = mine.encode(texts)
    where = 0
    for text, n in zip(texts, counts):
        assert ids[where:where + n].tolist() == library(data).encode_ordinary(text)
        where += n


LIBRARY = {}


def library(data):
    if not LIBRARY:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        LIBRARY["x"] = tiktoken.Encoding("t2", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=ranks, special_tokens={})
    return LIBRARY["x"]


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"),
                                (3, "word " * 60_000, None)], "doc_id long, text string, ids string")
    got = bpe_decode(bpe_encode(df, PATH), PATH, keep=("doc_id", "ids")).collect()
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded).decode()) for r in got) == sorted(
        [(1, 2, "a b"), (2, 0, ""), (2, 0, ""), (0, 0, ""), (3, 60_001, "word " * 60_000)])
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_query(spark, sf, other):
    from newsgrid.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_bpe_round_trip"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        ids = other.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
