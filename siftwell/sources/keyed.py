"""Tables of sqlite files, read by ranges of row keys.

A table is a tree ordered by row key, so a task that opens a file where it lies finds the
first row of any range in a few page reads.  Three steps, each a Spark job over small rows:

1. the catalogue: each file's tables, their row key and its least and greatest value;
2. pieces: spans of keys are dealt to tasks, which cut them after every so many rows and note
   for each piece its rows and which kinds of values each column holds;
3. rows: each piece is read by itself, straight into typed columns.

Pieces hold equally many rows however the keys lie, so gaps and clusters of keys cost nothing
when rows are read.  Counts and column types are merged from pieces, so no row is parsed to
learn the schema.  A task holds one batch of rows.

Defined cases: a column of whole numbers is long, of numbers double, of anything else (texts,
mixed values, nothing) string; bytes come as hexadecimal digits; names that differ in case are
one column, called as the first in order; a column that a file lacks is null there; tables
without row keys are one piece; empty tables have none; repeated rows stay; a text that isn't
UTF-8 has its bad bytes replaced.
"""

from __future__ import annotations

import contextlib
import itertools
import sqlite3
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.sources import readers, scratch
from siftwell.sources.ranges import Ranged, tasks

#: Bits for the kinds of values in a column, by sqlite's names of them.
KINDS = {"integer": 1, "real": 2, "text": 4, "blob": 8}
SPAN = "path string, name string, key string, columns array<string>, low long, high long"
PIECE = "path string, name string, key string, columns array<string>, first long, last long, n_rows long, kinds array<int>"


@contextlib.contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    with Ranged(path) as file:
        con, held = readers.sqlite_open(file)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        with held, contextlib.closing(con):
            yield con


def row_key(con: sqlite3.Connection, table: str, columns: list[str]) -> str | None:
    """What a table's row key is called; None if it has none, or columns of its own hide all its names."""
    for name in ("rowid", "_rowid_", "oid"):
        if name not in {c.lower() for c in columns}:
            with contextlib.suppress(sqlite3.OperationalError):
                con.execute(f"SELECT {name} FROM {readers.quoted(table)} LIMIT 0")
                return name
    return None


def spans(files: DataFrame, table: str | None = None, every: bool = False, step: int = 64 << 20) -> DataFrame:
    """(path, name, key, columns, low, high): even spans of keys, one for each ``step`` bytes of a file; of the table of that name, of every table, or of each file's first."""

    def look(batches):
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                with opened(path) as con:
                    names = readers.sqlite_tables(con)
                    for name in names if every else [n for n in names if n == (table or names[0])]:
                        columns = [d[0] for d in con.execute(f"SELECT * FROM {readers.quoted(name)} LIMIT 0").description]
                        key, low, high = row_key(con, name, columns), None, None
                        if key:
                            # each end by itself is found at the edge of the tree; both in one SELECT would read the table
                            low, high = (con.execute(f"SELECT {end}({key}) FROM {readers.quoted(name)}").fetchone()[0] for end in ("min", "max"))
                            if low is None:
                                continue
                            width = max(1, -((low - high - 1) // max(1, -(-length // step))))
                            out += [(path, name, key, columns, at, min(high, at + width - 1)) for at in range(low, high + 1, width)]
                        else:
                            out.append((path, name, None, columns, None, None))
                yield from made(out, SPAN)

    return files.select("path", "length").mapInArrow(look, SPAN)


def made(rows: list[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def cuts(con: sqlite3.Connection, table: str, key: str, low: int, high: int, rows: int) -> Iterator[tuple[int, int]]:
    """(first, last) keys of stretches of ``rows`` rows, the last one maybe shorter."""
    table = readers.quoted(table)
    while low <= high:
        first = con.execute(f"SELECT {key} FROM {table} WHERE {key} BETWEEN ? AND ? ORDER BY {key} LIMIT 1", (low, high)).fetchone()
        if first is None:
            return
        end = con.execute(f"SELECT {key} FROM {table} WHERE {key} BETWEEN ? AND ? ORDER BY {key} LIMIT 1 OFFSET ?", (first[0], high, rows - 1)).fetchone()
        last = end[0] if end else high
        yield first[0], last
        low = last + 1


def bounded(key: str | None, first: int | None, last: int | None) -> tuple[str, tuple]:
    return (f" WHERE {key} BETWEEN ? AND ?", (first, last)) if key else ("", ())


def pieces(found: DataFrame, rows: int = 50_000) -> DataFrame:
    """(path, name, key, columns, first, last, n_rows, kinds) of spans: stretches of ``rows`` rows, with the kinds of values in each column."""

    def look(batches):
        for span in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            name, key = span["name"], span["key"]
            masks = [" + ".join(f"{bit} * max(typeof({readers.quoted(c)}) = '{kind}')" for kind, bit in KINDS.items()) for c in span["columns"]]
            with opened(span["path"]) as con:
                for first, last in cuts(con, name, key, span["low"], span["high"], rows) if key else [(None, None)]:
                    where, given = bounded(key, first, last)
                    n = con.execute(f"SELECT count(*) FROM {readers.quoted(name)}{where}", given).fetchone()[0]
                    if n:
                        kinds = con.execute(f"SELECT {', '.join(masks)} FROM {readers.quoted(name)}{where}", given).fetchone()
                        yield from made([(span["path"], name, key, span["columns"], first, last, n, list(kinds))], PIECE)

    n = found.count()
    return found.repartition(tasks(n, 0, 1), "path", "name", "low").mapInArrow(look, PIECE)


def saved(spark: SparkSession, files: DataFrame, table: str | None = None, every: bool = False, rows: int = 50_000, step: int = 64 << 20) -> DataFrame:
    """The pieces of files, kept in the shared folder: a row for each ``rows`` rows."""
    at = f"{scratch.new_folder(spark)}/pieces"
    pieces(spans(files, table, every, step), rows).write.parquet(at)
    return spark.read.schema(PIECE).parquet(at)


def schema_of(found: DataFrame) -> T.StructType:
    """The columns of all pieces, in order of their place in the files, then by name; rows of the schema's size come to the driver."""
    each = found.select(F.posexplode(F.arrays_zip("columns", "kinds")).alias("place", "c")).groupBy(F.lower("c.columns").alias("low"))
    merged = each.agg(F.min("c.columns").alias("name"), F.min("place").alias("place"), F.bit_or("c.kinds").alias("kinds")).collect()
    kind = lambda mask: T.LongType() if mask == 1 else T.DoubleType() if mask in (2, 3) else T.StringType()
    return T.StructType([T.StructField(r.name, kind(r.kinds)) for r in sorted(merged, key=lambda r: (r.place, r.low))])


def as_array(values: Any, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.LongType):
        return pa.array(values, pa.int64())
    if isinstance(kind, T.DoubleType):
        return pa.array([None if v is None else float(v) for v in values], pa.float64())
    return pa.array([v if v is None or isinstance(v, str) else v.hex() if isinstance(v, bytes) else str(v) for v in values], pa.string())


def rows_of(found: DataFrame, batch_rows: int = 512) -> DataFrame | None:
    """The rows of pieces, which spread over tasks; None if there are none."""
    schema = schema_of(found)
    if not schema.fields:
        return None

    def read(batches):
        for piece in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            place = {c.lower(): i for i, c in enumerate(piece["columns"])}
            where, given = bounded(piece["key"], piece["first"], piece["last"])
            with opened(piece["path"]) as con:
                rows = con.execute(f"SELECT * FROM {readers.quoted(piece['name'])}{where}", given)
                while held := rows.fetchmany(batch_rows):
                    columns = list(zip(*held, strict=True))
                    none = [None] * len(held)
                    yield pa.RecordBatch.from_arrays([as_array(columns[place[f.name.lower()]] if f.name.lower() in place else none, f.dataType) for f in schema], names=schema.names)

    return found.repartition(tasks(found.count(), 0, 1), "path", "name", "first").mapInArrow(read, schema)


def read_sqlite(spark: SparkSession, files: DataFrame, table: str | None = None, rows: int = 50_000, step: int = 64 << 20) -> DataFrame | None:
    """A table of sqlite files (path, length) that lie in a file system, the first of each file if none is named; None without rows."""
    return rows_of(saved(spark, files, table, False, rows, step))


def table_counts(spark: SparkSession, files: DataFrame, rows: int = 50_000, step: int = 64 << 20) -> DataFrame:
    """(path, name, n_rows, n_pieces, largest) of every table that has rows: exact, counted by all pieces' tasks."""
    found = saved(spark, files, None, True, rows, step)
    return found.groupBy("path", "name").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_pieces"), F.max("n_rows").alias("largest"))
