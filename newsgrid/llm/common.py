"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrid.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with DuckDB SQL where there is any."""
    def enter(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return enter


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark)}/newsgrid-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.getParent())
    files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the path, for ``delete``.

    Cuts lineage, so a lost executor replays one stage at most, and fixes what
    later passes see.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``written`` without the path, for what is kept until the driver's JVM ends."""
    return written(df, label)[0]


def delete(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of this module's that nothing reads any more."""
    if path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` units each; a larger row is one alone."""
    cuts, start, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            cuts.append((start, i))
            start, total = i, 0
        total += n
    if start < len(lengths):
        cuts.append((start, len(lengths)))
    return cuts


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row's list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
