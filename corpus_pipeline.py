"""Corpus preparation from documents to tokens, one operator of newsgrid.llm a stage.

Every stage takes and returns documents with all their columns, whatever else
there are; the last one returns token counts and digests.  What becomes of null
and empty texts, ties, repeated rows and empty tables is stated with each
operator; in short:

* a document without a letter, or in no language for sure, goes;
* later repeated runs of lines are cut from texts, and texts may become empty;
* of documents that are near copies, by SimHash or shingles, the one with the least ``doc_id`` stays;
* documents that contain a benchmark item go; rows without ``doc_id`` stay;
* the texts that are left are encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsgrid.llm.common import materialise
from newsgrid.llm.crf import drop_unidentified, held_out
from newsgrid.llm.decontaminate import drop_contaminated
from newsgrid.llm.jaccard import drop_similar
from newsgrid.llm.lines import dedup_lines
from newsgrid.llm.queries import bpe_digest
from newsgrid.llm.simhash import group_near

SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in an identified language."""
    return drop_unidentified(docs, ~held_out())


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: texts without runs of lines that occur earlier."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of near copies.

    Texts are linked by SimHash, and by an exact shingle similarity of 0.8 or more,
    which reaches further than 4 bits.
    """
    return drop_similar(docs, words=SHINGLE_WORDS, linked=lambda texts: group_near(texts, key="content"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token counts and digests of the texts that are left."""
    return bpe_digest(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("encode", encode),
]

# A conditional random field, SimHash and byte-level BPE are not expressible in SQL;
# tests/llm/test_pipeline.py compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
