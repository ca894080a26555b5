"""Profiles of growing folders: what is known of each file is kept and merged.

A state holds, for a file and a column, numbers that merge: counts, bounds, sums, squared
distances from the mean, and a sketch of distinct values.  ``refresh`` scans the files whose
fingerprint (path, size, time of change) it has no states of, all of them in one aggregate with
the file as a key, appends their states to a store, and merges the states of the files that are
there now.  So added files cost a scan of themselves, changed ones count as new, and deleted
ones drop out.

Counts, bounds and totals of whole numbers are exact and merge to what a scan of all files
gives; means and deviations of floats agree but for rounding; distinct counts are estimates.

Defined cases: nulls, NaN and blank strings are missing, as in every profile; columns that a
file lacks are missing in it, and names of folders are no columns; a file without rows has no state; two runs at once may append one
file's states twice, of which one is taken; an empty folder can't be read, as in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import is_numeric, missing, number
from siftwell.sources.footers import BOUNDS, bound, family

SIDES = tuple((f"{side}_{b}", fn, b) for b in BOUNDS for side, fn in (("low", F.min), ("high", F.max)))
#: A sketch of 2^12 registers has a standard error of about 1.6 %.
PRECISION = 12


def fingerprint() -> Column:
    """What tells a file from its other states, by Spark's own listing, on any store."""
    return F.sha2(F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.unix_micros("_metadata.file_modification_time").cast("string")), 256)


def column_states(df: DataFrame, columns: Sequence[str], file: Column) -> DataFrame:
    """(file, column, n_rows, n_missing, low_*, high_*, n_numbers, whole_total, total, squares, sketch): a row for each file and column, in one aggregate."""
    kinds, cells = {f.name: f.dataType for f in df.schema}, []
    for c in columns:
        kind, want = kinds[c], family(kinds[c])
        value = bound(c, kind) if want else None
        x = number(c, kind) if is_numeric(kind) else F.lit(None).cast("double")
        shown = F.when(~missing(c, kind), F.col(f"`{c}`").cast("string") if want else F.to_json(F.struct(f"`{c}`")))
        whole = F.col(f"`{c}`").cast("decimal(38,0)") if want == "whole" and is_numeric(kind) else F.lit(None).cast("decimal(38,0)")
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(missing(c, kind)).alias("n_missing"),
            *[(fn(value) if b == want else F.first(F.lit(None))).cast(BOUNDS[b]).alias(name) for name, fn, b in SIDES],
            F.count(x).alias("n_numbers"), F.sum(whole).alias("whole_total"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"),
            F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("squares"), F.hll_sketch_agg(shown, F.lit(PRECISION)).alias("sketch"),
        ))
    wide = df.groupBy(file.alias("file")).agg(*[c.alias(f"_{i}") for i, c in enumerate(cells)])
    return wide.select("file", F.inline(F.array(*[f"_{i}" for i in range(len(cells))])))


def merged(states: DataFrame) -> DataFrame:
    """(column, ...): the states of all files as one state a column."""
    sums = states.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), *[fn(name).alias(name) for name, fn, _ in SIDES],
        F.sum("n_numbers").alias("n_numbers"), F.sum("whole_total").cast("decimal(38,0)").alias("whole_total"), F.sum("total").alias("total"), F.hll_union_agg("sketch").alias("sketch"),
    )
    # distances from each file's own mean become distances from the mean of all
    centre = sums.select("column", F.try_divide("total", "n_numbers").alias("centre"))
    away = F.try_divide("total", "n_numbers") - F.col("centre")
    squares = states.join(centre, "column").groupBy("column").agg(F.sum(F.col("squares") + F.coalesce(F.col("n_numbers") * away * away, F.lit(0.0))).alias("squares"))
    order = [c for c in states.columns if c in sums.columns or c == "squares"]
    return sums.join(squares, "column").select(order)


def finished(state: DataFrame) -> DataFrame:
    """(column, n_rows, n_missing, missing_rate, low_*, high_*, mean, std, n_distinct): a state in words. mean and std are null for columns that hold no numbers."""
    mean = F.coalesce(F.try_divide(F.col("whole_total").cast("double"), F.col("n_numbers")), F.try_divide("total", "n_numbers"))
    return state.select(
        "column", "n_rows", "n_missing", F.try_divide("n_missing", "n_rows").alias("missing_rate"), *[name for name, _, _ in SIDES],
        mean.alias("mean"), F.sqrt(F.try_divide("squares", "n_numbers")).alias("std"), F.hll_sketch_estimate("sketch").alias("n_distinct"),
    )


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The states of a store, one of each file and column; None before there are any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(store).dropDuplicates(["file", "column"])


def refresh(spark: SparkSession, path: str, store: str, recursive: bool = True) -> DataFrame:
    """The profile (``finished``) of a folder's Parquet files; only files that the store doesn't know are read."""
    look = str(recursive).lower()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", look).load(path).select("path", fingerprint().alias("file"))
    known = stored(spark, store)
    fresh = listed if known is None else listed.join(known.select("file").distinct(), "file", "left_anti")
    # Spark's reader takes paths from the driver, where its own listing of the folder is held too
    paths = [r.path for r in fresh.select("path").collect()]
    if paths:
        # names of files may hold signs that stand for others in paths
        rows = spark.read.option("mergeSchema", "true").parquet(*[re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
        column_states(rows, rows.columns, fingerprint()).write.mode("append").parquet(store)
    held = stored(spark, store)
    if held is None:
        raise ValueError(f"no Parquet rows in {path}")
    return finished(merged(held.join(listed.select("file"), "file", "left_semi")))
