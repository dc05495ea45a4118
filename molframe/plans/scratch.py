"""Folders for queries that write: in the shared checkpoint folder, or a temporary one in local mode."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder, deleted when the application ends."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        named = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{named.rstrip('/')}/molframe-{uuid.uuid4().hex}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
