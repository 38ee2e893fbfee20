"""Folders for tables and state that outlive a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, removed when the session ends.

    It is under spark.checkpoint.dir; where that is unset, under a temporary folder
    on a local master, else in the warehouse.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = tempfile.gettempdir() if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    home = f"{base.rstrip('/')}/telemill-{name}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return home
