import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from newsgrid.llm.crf import held_out, identify
from newsgrid.llm.simhash import group_near
from test_decontaminate import plain as find_plain
from test_jaccard import plain as similar_plain
from test_lines import plain as lines_plain


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_each_stage_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_copies", "benchmark", "encode"]
    found = {r.doc_id: r for r in identify(docs, ~held_out()).collect()}
    want = sorted((k, t) for k, t in pairs(docs)
                  if found[k].lang_pred != "und" and found[k].score >= 0.4)
    now = stages["language"](spark, docs, sf)
    assert now.columns == docs.columns and pairs(now) == want
    assert len(want) > 0.95 * docs.count()
    now = stages["lines"](spark, now, sf)
    want = sorted(lines_plain(want).items())
    assert now.columns == docs.columns and pairs(now) == want
    now = stages["near_copies"](spark, now, sf)
    stay = set(similar_plain(want)[0])
    want = [(k, t) for k, t in want if k in stay]
    assert now.columns == docs.columns and pairs(now) == want
    now = stages["benchmark"](spark, now, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {k for k, *_ in find_plain(want, items)}
    want = [(k, t) for k, t in want if k not in bad]
    assert now.columns == docs.columns and pairs(now) == want
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tokens = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                               special_tokens={})
    want = sorted((k, len(ids), hashlib.sha256(t.encode()).hexdigest())
                  for k, t in want for ids in [tokens.encode_ordinary(t)])
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256)
                  for r in stages["encode"](spark, now, sf).collect()) == want
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256)
                  for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_edges(spark, sf):
    text = "the word and another one of these with more than one letter in it"
    rows = [(i, f"{text} {i} number", "en", "s", 9, "a", 1.5, b"x", [1], "row") for i in range(1, 60, 2)]
    rows += [(2, None, None, None, None, None, None, None, None, None), (4, "", "en", "", 0, "", 0.0, b"", [], ""),
             (6, "?!", "en", "s", 2, "a", 1.0, b"x", [1], "row"), (1, rows[0][1], "en", "s", 9, "a", 1.5, b"x", [1], "row"),
             (None, text, "en", "s", 9, "a", 1.5, b"x", [1], "row"),
             (8, "long " * 50_000, "en", "s", 9, "a", 1.5, b"x", [1], "row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "lang_pred string, score double, print binary, spans array<int>, row string")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            got = stage(spark, df, sf)
            if name != "encode":
                assert got.columns == df.columns
            n = got.count()
            assert n == 0 if df is not docs else 0 < n <= docs.count()


def test_near_copies_by_fingerprint(spark):
    """Operator 1 links texts of one fingerprint whose shingle sets differ; similar texts of both join the group."""
    line = "one two three four five " * 200
    tails = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    other = " ".join(f"w{i}" for i in range(200))
    rows = [(1, line + tails[0]), (2, line + tails[1]), (3, line + tails[1] + " more"), (4, tails[2][:90]),
            (5, other), (6, other + " end"), (None, line + tails[2]), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in group_near(docs.filter("doc_id <= 3")).collect()}
    assert groups[2] == 1 and not jaccard_links(rows[0][1], rows[1][1])
    got = corpus_pipeline.near_copies(spark, docs, None)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "5", "7", "None"]


def jaccard_links(a, b):
    return len(similar_plain([(0, a), (1, b)])[0]) == 1
