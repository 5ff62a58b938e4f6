"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, else under the warehouse. Only a local session may use a temporary folder; on a cluster
    a warehouse on a machine's own disk raises an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    elif not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/shiftlens-work"
        if base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"
