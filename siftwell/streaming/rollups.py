"""Windowed rollups of a stream: counts, missing values, mean and spread by label, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftwell.functions import missing


def by_window(df: DataFrame, time: str, label: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """(window_start, window_end, label, n, n_missing, mean, std); ``late``: how late rows may come, for streams."""
    rows = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late and df.isStreaming else df
    kind = df.schema[value].dataType
    x = F.when(~missing(value, kind), F.col(value).cast("double"))
    out = rows.groupBy(F.window(time, width).alias("w"), F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"), F.count_if(missing(value, kind)).alias("n_missing"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "n", "n_missing", "mean", "std")


def follow(spark: SparkSession, folder: str, schema: StructType, time: str, label: str, value: str, width: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """Rolls up parquet files as they come into a folder, once for all that is there; closed windows are appended."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return by_window(stream, time, label, value, width, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def detected_stream(spark: SparkSession, folder: str, sniff: int = 256 * 1024) -> DataFrame:
    """A stream of (path, length, file_type, confidence, reason, details) for files that come into a folder."""
    from siftwell.sources.detect import detected

    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).load(folder).select("path", "length", "content")
    return detected(files, F.col("path"), F.col("content"), sniff).drop("content")
