"""Where a session keeps its checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Sets the checkpoint folder to the one named by ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(named)
