"""Where the catalogue modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _longs(fn):
    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c)
                           for c, t in df.dtypes])
    return run


def query(name: str, oracle: str | None = None, longs: bool = False):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its DuckDB equivalent.

    ``longs`` widens integer columns where the other engine counts in 64 bits.
    """
    def enter(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _longs(fn) if longs else fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return enter
