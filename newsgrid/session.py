"""Session settings the jobs are written for, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change plans, not results.  AQE splits skewed join partitions
# and coalesces small ones; the group-limit rule keeps top-k-per-key map-side.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "newsgrid", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the recommended settings; ``extra`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in one JVM may do without: it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="newsgrid-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


SCAN_PARTITIONS = "spark.newsgrid.scanPartitions"


def dealt(scan: DataFrame) -> DataFrame:
    """The scan dealt out to as many partitions as the session asks for, if it does.

    For files that Spark can't split, like a table in one row group; unset, the
    scan stays as it is.
    """
    wanted = scan.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return scan.repartition(int(wanted)) if wanted else scan


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/scratch/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage, so lost executors do not replay it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
