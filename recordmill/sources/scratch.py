"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("recordmill.scratch.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recordmill-")
        spark.conf.set("recordmill.scratch.dir", found)
    return found.rstrip("/")
