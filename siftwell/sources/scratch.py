"""Where files that driver and executors share may be written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, the warehouse, or in local mode a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        here = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        path = "file://" + tempfile.mkdtemp(prefix="siftwell-shared-") if here else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftwell-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of one's own in the shared one; it goes when the application ends."""
    root = f"{shared_folder(spark)}/siftwell-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root
