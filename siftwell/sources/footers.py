"""Profiles of Parquet files from their footers.

A footer holds rows, nulls, least and greatest value of each column in each row group.  Tasks
read the footers of the files that they are dealt (eight bytes, then the footer, no data), and
one aggregate by column merges what they say.  A column whose statistics are incomplete in any
row group is scanned, together with others of its kind and without the rest of the table.

Bounds are typed: ``whole`` for integers, truth values, days (dates) and microseconds
(timestamps); ``real`` for floats and decimals, as double, NaN apart; ``text`` for strings, by
their UTF-8 bytes.  Other types have counts alone.

Taken for incomplete: nested columns (their null counts tell of elements), bounds that are NaN,
nanoseconds, and texts of ``CUT`` bytes or more, which some writers cut.  A column that a file
lacks is null in all of its rows.  Folders without rows give counts of zero.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.sources import ranges

CUT = 64
BOUNDS = {"whole": "long", "real": "double", "text": "string"}
#: Microseconds of a file's time units.
UNITS = {"milliseconds": 1000, "microseconds": 1}


def family(kind: T.DataType) -> str | None:
    """Which bounds a column of this type has."""
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "whole"
    if isinstance(kind, T.NumericType):
        return "real"
    return "text" if isinstance(kind, T.StringType) else None


def bound(name: str, kind: T.DataType) -> Column:
    """A value as its family's bounds hold it."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        # the clock's own fields: no time zone has a say
        seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return (seconds * 1000000 + F.extract(F.lit("SECOND"), c) * 1000000).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double")) + F.lit(0.0)
    return c.cast(BOUNDS[family(kind) or "text"])


def footer(file: ranges.Ranged) -> pq.FileMetaData:
    """The footer of an open file, by two reads."""
    tail = file.range(file.size - 8, file.size)
    size = int.from_bytes(tail[:4], "little")
    if len(tail) < 8 or tail[4:] != b"PAR1" or size + 12 > file.size:
        raise ValueError("no Parquet footer")
    return pq.read_metadata(pa.BufferReader(b"PAR1" + file.range(file.size - 8 - size, file.size - 8) + tail))


def statistic(chunk: pq.ColumnChunkMetaData, rows: int, want: str | None) -> tuple[int | None, dict[str, Any] | None]:
    """(nulls, bounds) of a chunk, None where the footer doesn't tell; bounds are empty if all values are null."""
    st = chunk.statistics if chunk.is_stats_set else None
    if st is None or not st.has_null_count:
        return None, None
    nulls = st.null_count
    if want is None or nulls == rows:
        return nulls, {}
    if not st.has_min_max:
        return nulls, None
    logical, found = json.loads(st.logical_type.to_json()), {}
    for side, value, raw in (("low", st.min, st.min_raw), ("high", st.max, st.max_raw)):
        if logical.get("Type") == "Timestamp":
            factor = UNITS.get(logical.get("timeUnit"))
            value = raw * factor if factor and isinstance(raw, int) else None
        elif isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
            value = raw
        fits = {
            "whole": isinstance(value, int) and -(1 << 63) <= value < 1 << 63,
            "real": isinstance(value, (int, float, decimal.Decimal)) and not math.isnan(value),
            "text": isinstance(value, str) and len(value.encode()) < CUT,
        }[want]
        if not fits:
            return nulls, None
        found[side] = {"whole": int, "real": float, "text": str}[want](value)
    return nulls, found


def footer_rows(files: DataFrame, schema: T.StructType) -> DataFrame:
    """(path, column, n_rows, n_nulls, low_*, high_*, complete, n_read) of files (path, length, content): a row for each row group and column of schema."""
    wanted = {f.name: family(f.dataType) for f in schema}
    nested = [f.name for f in schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    sides = [f"{s}_{b}" for b in BOUNDS for s in ("low", "high")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict[str, Any]] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with ranges.Ranged(path, content) as file:
                    meta = footer(file)
                    read = file.n_read
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    chunks = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
                    tops = {p.split(".")[0] for p in chunks}
                    for name, want in wanted.items():
                        row = {"path": path, "column": name, "n_rows": group.num_rows, "n_nulls": None, **dict.fromkeys(sides), "complete": False, "n_read": read if not g else 0}
                        if name in chunks and name not in nested:
                            row["n_nulls"], found = statistic(chunks[name], group.num_rows, want)
                            row["complete"] = row["n_nulls"] is not None and found is not None
                            row |= {f"{side}_{want}": v for side, v in (found or {}).items()}
                        elif name not in tops:
                            row["n_nulls"], row["complete"] = group.num_rows, True
                        out.append(row)
            yield pa.RecordBatch.from_pylist(out, made)

    types = {"path": "string", "column": "string", "n_rows": "long", "n_nulls": "long", **{s: BOUNDS[s.split("_")[1]] for s in sides}, "complete": "boolean", "n_read": "long"}
    arrow = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    made = pa.schema([(k, arrow[v]) for k, v in types.items()])
    found = files.agg(F.count("*").alias("n")).first().n
    # a footer is a small read, so a task takes some; content comes along only for stores that Python can't open
    return files.select("path", "content").repartition(max(1, min(found, 32 + found // 64)), "path").mapInArrow(look, ", ".join(f"`{k}` {v}" for k, v in types.items()))


def scanned(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns' rows of a profile, from their values."""
    cells = []
    for f in df.schema:
        if f.name in names:
            own, want = F.col(f"`{f.name}`"), family(f.dataType)
            value = bound(f.name, f.dataType) if want else None
            sides = [(fn(value) if b == want else F.first(F.lit(None))).cast(kind).alias(f"{side}_{b}") for b, kind in BOUNDS.items() for side, fn in (("low", F.min), ("high", F.max))]
            cells.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(own.isNull()).alias("n_nulls"), *sides, F.lit(False).alias("from_footers")))
    return df.select(*[f"`{n}`" for n in names]).agg(*[c.alias(f"_{i}") for i, c in enumerate(cells)]).select(F.inline(F.array(*[f"_{i}" for i in range(len(cells))])))


def footer_profile(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(column, n_rows, n_nulls, low_whole, high_whole, low_real, high_real, low_text, high_text, from_footers) of a Parquet file or folder."""
    table = spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(path)
    files = ranges.list_files(spark, path, recursive)
    sides = [fn(f"{side}_{b}").alias(f"{side}_{b}") for b in BOUNDS for side, fn in (("low", F.min), ("high", F.max))]
    merged = footer_rows(files, table.schema).groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), *sides, F.bool_and("complete").alias("from_footers"))
    # a row for each column of the schema: all of these fit the driver
    told = merged.collect()
    lacking = [r.column for r in told if not r.from_footers]
    empty = [c for c in table.columns if c not in {r.column for r in told}]
    out = spark.createDataFrame([r for r in told if r.from_footers], merged.schema)
    for names in (lacking, empty):
        if names:
            out = out.unionAll(scanned(table, names).select(*out.columns))
    return out.withColumn("low_real", F.col("low_real") + F.lit(0.0)).withColumn("high_real", F.col("high_real") + F.lit(0.0))
