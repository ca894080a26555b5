"""Types of JSON records as states that merge: one scan, any nesting, any mix of types.

A state row says of one path and one kind of value how many values there are and how large they
are.  Tasks count their own records and give a few rows each; Spark adds these up.  States of
two tables, or of a folder's old and new files, add up to the state of both.  A node's type is
the least one above the kinds it holds; from the nodes follow a schema and, without another
scan to infer it, the table.

Paths: ``$`` is the record, ``$.name`` and ``$['other name']`` a key of an object, ``[]`` the
elements of an array.  Kinds: null, boolean, long, double, string, object, array; texts that
aren't JSON are ``malformed`` and null texts ``absent``, both at ``$``.

Defined cases: numbers beyond 64 bits are doubles; of repeated keys the last counts; NaN and
Infinity, which JSON lacks, make a text malformed, as does nesting too deep for the parser;
repeated rows each count; an empty table has no states.  Keys that are data (a path for each
record) make as many state rows, which are grouped and counted like any others; only a schema
of more than ``most`` nodes is refused, with an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.sources import scratch

SIZES = ("low_size", "high_size", "sum_size")
STATE = "path string, parent string, name string, kind string, n long, low_size long, high_size long, sum_size long"
PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Partial states that a task holds before it hands them on.
HELD = 1 << 16


def step(name: str) -> str:
    return f".{name}" if PLAIN.match(name) else "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def refuse(token: str) -> None:
    raise ValueError(token)


def sized(value: Any) -> tuple[str, int]:
    """The kind of a value, and its elements, keys, characters, or characters as JSON."""
    if value is None:
        return "null", 4
    if isinstance(value, bool):
        return "boolean", 4 if value else 5
    if isinstance(value, int):
        return ("long" if -(2**63) <= value < 2**63 else "double"), len(str(value))
    if isinstance(value, float):
        return "double", len(repr(value))
    return {str: "string", dict: "object", list: "array"}[type(value)], len(value)


def walk(text: str | None) -> list[tuple[str, str | None, str | None, str, int]]:
    """(path, parent, name, kind, size) of all values in a text."""
    if text is None:
        return [("$", None, None, "absent", 0)]
    try:
        root = json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return [("$", None, None, "malformed", len(text))]
    out, left = [], [("$", None, None, root)]
    while left:
        path, parent, name, value = left.pop()
        out.append((path, parent, name, *sized(value)))
        if isinstance(value, dict):
            left += [(path + step(k), path, k, v) for k, v in value.items()]
        elif isinstance(value, list):
            left += [(path + "[]", path, None, v) for v in value]
    return out


def states(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """State rows of JSON texts, one set for each value of the string columns ``by`` (such as a file's path), kept in the shared folder."""
    keys = [f"_by_{i}" for i in range(len(by))]
    given = df.select(*[F.col(c).cast("string").alias(k) for c, k in zip(by, keys, strict=True)], F.col(text).cast("string").alias("_text"))
    ddl = ", ".join([*[f"{k} string" for k in keys], STATE])
    kinds = pa.schema([*[(k, pa.string()) for k in (*keys, "path", "parent", "name", "kind")], *[(c, pa.int64()) for c in ("n", *SIZES)]])

    def handed(found: dict[tuple, list[int]]) -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def count(batches):
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for path, parent, name, kind, size in walk(row[-1]):
                    key = (*row[:-1], path, parent, name, kind)
                    at = found.get(key)
                    if at is None:
                        found[key] = [1, size, size, size]
                        continue
                    at[0] += 1
                    at[1], at[2], at[3] = min(at[1], size), max(at[2], size), at[3] + size
                if len(found) >= HELD:
                    yield handed(found)
                    found = {}
        if found:
            yield handed(found)

    parts = given.mapInArrow(count, ddl)
    # kept as a table, as several steps read them: the records are scanned once
    at = f"{scratch.new_folder(df.sparkSession)}/states"
    out = merged(parts.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "path", "parent", "name", "kind", "n", *SIZES), by)
    out.write.parquet(at)
    return df.sparkSession.read.schema(out.schema).parquet(at)


def merged(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """State rows added up; of all that differ in other columns than ``by``."""
    return found.groupBy(*by, "path", "parent", "name", "kind").agg(F.sum("n").alias("n"), F.min("low_size").alias("low_size"), F.max("high_size").alias("high_size"), F.sum("sum_size").alias("sum_size"))


def least_type(kinds: Column) -> Column:
    """The least type above a node's kinds: null is below all; long is below double; any other two are ``mixed``."""
    solid = F.array_remove(F.array_remove(F.array_remove(kinds, "null"), "absent"), "malformed")
    return F.when(F.size(solid) == 0, "null").when(F.size(solid) == 1, solid[0]).when(F.size(F.array_except(solid, F.array(F.lit("long"), F.lit("double")))) == 0, "double").otherwise("mixed")


def nodes(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each path of merged states: parent, name, type, n, n_null, n_missing (objects of the parent without this key; null for records and elements), kinds with their counts, sizes."""
    each = found.groupBy(*by, "path", "parent", "name").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("n_null"), F.sum(F.when(F.col("kind") == "object", F.col("n"))).alias("objects"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("low_size").alias("low_size"), F.max("high_size").alias("high_size"))
    above = each.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("path").alias("_path"), F.col("objects").alias("_objects"))
    same = F.col("parent") == F.col("_path")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    missing = F.when(F.col("name").isNotNull(), F.col("_objects") - F.col("n"))
    return each.join(above, same, "left").select(*by, "path", "parent", "name", least_type(F.col("kinds")).alias("type"), "n", "n_null", missing.alias("n_missing"), "kinds", "low_size", "high_size")


def schema_of(found: DataFrame, most: int = 20_000) -> T.StructType | None:
    """The schema of the objects in nodes; None without objects or keys. Mixed and empty nodes are strings, which hold any value as JSON; so are keys of one object that differ in case only, which a struct can't hold apart."""
    rows = found.select("path", "parent", "name", "type", "kinds").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"More than {most} paths: some keys seem to be data.")
    under: dict[str | None, list] = {}
    for r in rows:
        under.setdefault(r.parent, []).append(r)

    def struct(path: str) -> T.DataType:
        held = sorted((r for r in under.get(path, []) if r.name is not None), key=lambda r: r.name)
        if not held or len({r.name.lower() for r in held}) < len(held):
            return T.StringType()
        return T.StructType([T.StructField(r.name, typed(r)) for r in held])

    def typed(row: Any) -> T.DataType:
        if row.type == "object":
            return struct(row.path)
        if row.type == "array":
            return T.ArrayType(next((typed(r) for r in under.get(row.path, []) if r.name is None), T.StringType()))
        return {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType()}.get(row.type, T.StringType())

    root = struct("$")
    return root if isinstance(root, T.StructType) else None


def table_of(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame | None:
    """The JSON objects of a text column as columns beside ``keep``; records that are no objects are left out. One scan finds the types, another reads."""
    schema = schema_of(nodes(states(df, text)))
    if schema is None:
        return None
    corrupt = "_corrupt"
    while corrupt in schema.names:
        corrupt += "_"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "allowSingleQuotes": "false"}
    whole = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    read = df.select(*keep, F.col(text).alias("_text")).where(F.ltrim(F.col("_text")).startswith("{")).select(*keep, F.from_json("_text", whole, options).alias("_r"))
    return read.where(F.col("_r")[corrupt].isNull()).select(*keep, *[F.col("_r")[f].alias(f) for f in schema.names])
