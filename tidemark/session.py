"""What every query needs of the session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Rows that a task sorts or groups at most, keys allowing.
TASK_ROWS = 1_000_000


def put_on_path(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed (local runs, shared folders)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows: in proportion to them, so that a task's memory doesn't grow with the input; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
