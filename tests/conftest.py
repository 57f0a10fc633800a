import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("newsgrid-tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one column expression, optionally over literal inputs."""
    from pyspark.sql import functions as F

    def run(build, **inputs):
        df = spark.range(1)
        for name, value in inputs.items():
            df = df.withColumn(name, value if hasattr(value, "_jc") else F.lit(value))
        return df.select(build.alias("x")).first()["x"]
    return run
