"""What the training-data operators share: table access, shared-folder tables, word rules.

Words are runs of bytes other than space and \\x09-\\x0D.  Python code splits UTF-8
bytes, because ``bytes.split`` and ``bytes.lower`` know ASCII only, as the rule says.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources import scratch

#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Shared:
    """Tables written to the shared folder, so that lost executors cost no lineage.

    ``drop`` deletes one early; whatever is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, scratch.new_folder(spark)

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self) -> Any:
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(f"{self.root}/{name}"), True)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished jobs now; it does so when the driver's garbage is collected, else whenever that is."""
        self.spark._jvm.System.gc()


def utf8(text: Column | str) -> Column:
    """The text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def py_crc_bucket(doc_id: int | None, buckets: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % buckets


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow whose function gets ``rows`` rows at most at a time.

    Spark bounds a batch by bytes (64 MB unless set otherwise) and by 10,000 rows; slicing it
    in the task bounds the Python objects made of it, whatever other operators do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)
