"""Queries over files that Spark writes from the tables first: every reader, and tables cut at any place."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile
from collections.abc import Callable
from typing import Any
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.context import Options
from siftwell.plans.catalogue import query, table, unions
from siftwell.plans import states
from siftwell.plans.inspect import table_of
from siftwell.sources import footers, keyed, ranges, readers, scratch, split, structure
from siftwell.sources.detect import detect_files

NAMES = ("p_partkey", "p_size", "p_retailprice", "p_brand")


def part(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of part with the file that each goes to: about 500 keys a file."""
    return table(spark, sf, "part").select(*NAMES, (F.col("p_partkey") / 500).cast("int").alias("file"))


def cells(tag: str, before: str = "") -> Column:
    return F.concat(*[F.concat(F.lit(f"{before}<{tag.format(c)}>"), F.col(c).cast("string"), F.lit(f"</{tag.format(c)}>")) for c in NAMES])


def texts() -> dict[str, tuple[str, Column, str, str, str]]:
    """How a row is written in text formats: what stands before all rows, the row, what stands between and behind."""
    yaml = F.concat(*[F.concat(F.lit(("- " if c == NAMES[0] else "  ") + f"{c}: "), F.col(c).cast("string"), F.lit("" if c == NAMES[-1] else "\n")) for c in NAMES])
    head = "".join(f"<th>{c}</th>" for c in NAMES)
    return {
        "json_list": ("[\n", F.to_json(F.struct(*NAMES)), ",\n", "]"), "yaml": ("", yaml, "\n", ""),
        "xml": ('<?xml version="1.0"?><parts>', F.concat(F.lit("<part>"), cells("{}"), F.lit("</part>")), "\n", "</parts>"),
        "html": (f"<html><body><table><tr>{head}</tr>", F.concat(F.lit("<tr>"), cells("td"), F.lit("</tr>")), "\n", "</table></body></html>"),
    }


def totals(df: DataFrame, written: str, kind: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    key, size, price, brand = names
    return df.agg(F.lit(written).alias("written"), F.lit(kind).alias("file_type"), F.count("*").alias("n_rows"), F.sum(key).cast("long").alias("keys"), F.sum(size).cast("long").alias("sizes"), F.round(F.sum(price), 2).alias("prices"), F.countDistinct(brand).alias("brands"))


def want(kinds: dict[str, str]) -> str:
    return unions([f"SELECT '{name}' AS written, '{kind}' AS file_type, count(*) AS n_rows, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(sum(p_size) AS BIGINT) AS sizes, round(sum(p_retailprice), 2) AS prices, count(DISTINCT p_brand) AS brands FROM part" for name, kind in kinds.items()])


def kind_of(spark: SparkSession, path: str) -> str:
    """The one format of a folder's files, or all that were found."""
    return ",".join(sorted({r.file_type for r in detect_files(spark, path, True).select("file_type").distinct().collect()}))


TEXT_KINDS = {"json_list": "json", "yaml": "yaml", "xml": "xml", "html": "html"}


@query(want(TEXT_KINDS))
def read_text_formats(spark: SparkSession, sf: str) -> DataFrame:
    """part in files of text formats (JSON lists, YAML, XML, HTML tables), detected, and read again by what the detector said."""
    root, out = scratch.new_folder(spark), None
    for name, (before, row, between, behind) in texts().items():
        rows = part(spark, sf).groupBy("file").agg(F.array_join(F.collect_list(row), between).alias("rows"))
        rows.select("file", F.concat(F.lit(before), "rows", F.lit(behind))).write.partitionBy("file").text(f"{root}/{name}")
        kind = kind_of(spark, f"{root}/{name}")
        one = totals(readers.read_table(spark, f"{root}/{name}", kind), name, kind)
        out = one if out is None else out.unionAll(one)
    return out


# files that no writer of Spark's makes --------------------------------------


def as_sqlite(rows: list[dict[str, Any]]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE part (p_partkey INTEGER PRIMARY KEY, p_size INTEGER, p_retailprice REAL, p_brand TEXT)")
    con.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", [tuple(r[c] for c in NAMES) for r in rows])
    con.commit()
    return con.serialize()


def as_npz(rows: list[dict[str, Any]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, features=np.array([[r[c] for c in NAMES[:3]] for r in rows], np.float64), target=np.array([r["p_brand"] for r in rows]))
    return out.getvalue()


def as_xlsx(rows: list[dict[str, Any]]) -> bytes:
    space = "http://schemas.openxmlformats.org"
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    line = lambda i, values: f'<row r="{i}">' + "".join(cell(v).replace("<c", f'<c r="{"ABCD"[k]}{i}"', 1) for k, v in enumerate(values)) + "</row>"
    body = line(1, NAMES) + "".join(line(i, [r[c] for c in NAMES]) for i, r in enumerate(rows, 2))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="part" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def as_zip(rows: list[dict[str, Any]]) -> bytes:
    """Members of 25 rows each, CSV and JSON lines in turn, packed and stored in turn."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(0, len(rows), 25):
            some, packed = rows[i : i + 25], zipfile.ZIP_DEFLATED if i % 75 else zipfile.ZIP_STORED
            if i % 50:
                z.writestr(f"rows/{i}.jsonl", "\n".join(json.dumps(r) for r in some), packed)
            else:
                z.writestr(f"rows/{i}.csv", "\n".join([",".join(NAMES), *[",".join(str(r[c]) for c in NAMES) for r in some]]), packed)
    return out.getvalue()


def written(rows: DataFrame, folder: str, make: Callable[[list[dict[str, Any]]], bytes], names: tuple[str, ...] = NAMES) -> int:
    """Files of rows by ``file``, written by the tasks that hold them; how many. A task that runs again writes the same file again."""

    def write(data: pa.Table) -> pa.Table:
        held = make(data.select(list(names)).sort_by(names[0]).to_pylist())
        store, inner = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/{data['file'][0].as_py()}.bin") as f:
            f.write(held)
        return pa.table({"size": [len(held)]})

    return rows.groupBy("file").applyInArrow(write, "size long").count()


BINARY_KINDS = {"sqlite": "sqlite", "npz": "npz", "xlsx": "xlsx", "zip": "zip"}
#: What columns are called in the table read again.
BINARY_NAMES = {"npz": ("f0", "f1", "f2", "target")}
MAKERS = {"sqlite": as_sqlite, "npz": as_npz, "xlsx": as_xlsx, "zip": as_zip}


@query(want(BINARY_KINDS))
def read_binary_formats(spark: SparkSession, sf: str) -> DataFrame:
    """part in files that only Python reads (sqlite, npz, xlsx, and all members of zips), detected by their bytes, and read again."""
    root, out = scratch.new_folder(spark), None
    root = root if "://" in root else root.replace("file:", "file://", 1)
    for name in BINARY_KINDS:
        written(part(spark, sf), f"{root}/{name}", MAKERS[name])
        kind = kind_of(spark, f"{root}/{name}")
        if kind == "zip":
            df = readers.from_json_rows(readers.entry_rows(readers.zip_entries(spark, f"{root}/{name}")).select("value"))
        else:
            df = readers.read_table(spark, f"{root}/{name}", kind)
        one = totals(df, name, kind, BINARY_NAMES.get(name, NAMES))
        out = one if out is None else out.unionAll(one)
    return out


# tables cut at any place ----------------------------------------------------


@query("SELECT p_partkey, p_size, p_retailprice, length(p_name) + 2 * length(p_brand) + 11 AS note_chars, sha256(p_name || chr(10) || 'says \"' || p_brand || '\",' || chr(10) || chr(10) || p_brand) AS note_sha256 FROM part")
def split_quoted_csv(spark: SparkSession, sf: str) -> DataFrame:
    """part with line breaks, delimiters and quotes inside of cells, read in ranges of 997 bytes that begin anywhere."""
    note = F.concat("p_name", F.lit('\nsays "'), "p_brand", F.lit('",\n\n'), "p_brand")
    root = scratch.new_folder(spark)
    table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", note.alias("note")).write.options(header="true", quote='"', escape='"').csv(f"{root}/csv")
    files = ranges.list_files(spark, f"{root}/csv/*.csv")
    df = split.read_csv(spark, files, readers.csv_options({}, "csv"), step=997)
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_size", "p_retailprice", F.length("note").cast("long").alias("note_chars"), F.sha2("note", 256).alias("note_sha256"))


@query("SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS priorities, CAST(min(o_orderkey) AS BIGINT) AS first_key FROM orders GROUP BY o_custkey")
def split_json_lists(spark: SparkSession, sf: str) -> DataFrame:
    """orders as JSON lists with brackets and quotes in strings, a list for each 1,000 keys, read in ranges of 1,009 bytes that begin anywhere."""
    root = scratch.new_folder(spark)
    odd = F.concat(F.lit('["\\{ '), "o_orderpriority", F.lit(' }\\"]'))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", odd.alias("note"), F.struct(F.array("o_orderkey").alias("keys")).alias("deep"))
    lists = rows.groupBy((F.col("o_orderkey") / 1000).cast("int").alias("file")).agg(F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ", ").alias("rows"))
    lists.select("file", F.concat(F.lit("["), "rows", F.lit("]"))).write.partitionBy("file").text(f"{root}/json")
    df = split.read_json(spark, ranges.list_files(spark, f"{root}/json"), step=1009)
    return df.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("note").alias("priorities"), F.min(F.element_at("deep.keys", 1)).alias("first_key"))


@query("SELECT 'jsonl' AS file_type, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS keys, true AS read_in_part FROM lineitem")
def json_lines_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as JSON lines in .json files, told from their heads alone whatever their size, and read by Spark."""
    root = scratch.new_folder(spark)
    # a file for each part that Spark cuts the table into, however large the table is
    table(spark, sf, "lineitem").write.json(f"{root}/lines")
    found = structure.summarise_files(ranges.list_files(spark, f"{root}/lines")).select("file_type", "details", "summary").first()
    reads = detect_files(spark, f"{root}/lines").agg(F.bool_and((F.col("n_read") <= 262144) & (F.col("n_read") <= F.col("length"))).alias("read_in_part")).first()[0]
    df, _ = table_of(spark, f"{root}/lines", found.file_type, dict(found.details or {}), Options(), json.loads(found.summary))
    return df.agg(F.lit(found.file_type).alias("file_type"), F.count("*").alias("n_rows"), F.sum("l_orderkey").cast("long").alias("keys"), F.lit(reads).alias("read_in_part"))


# sqlite files by ranges of row keys -----------------------------------------

ORDER = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def as_orders(rows: list[dict[str, Any]]) -> bytes:
    """orders under keys with wide gaps between clusters, prices as text for one priority, and a table of prices without row keys."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE orders (o_orderkey INTEGER PRIMARY KEY, o_custkey INTEGER, o_totalprice, o_orderpriority TEXT)")
    con.execute("CREATE TABLE prices (o_orderkey INTEGER PRIMARY KEY, o_totalprice REAL) WITHOUT ROWID")
    spread = lambda k: k % 1000 + k // 1000 * 10**12
    con.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", [(spread(r["o_orderkey"]), r["o_custkey"], str(r["o_totalprice"]) if r["o_orderpriority"] == "5-LOW" else r["o_totalprice"], r["o_orderpriority"]) for r in rows])
    con.executemany("INSERT INTO prices VALUES (?, ?)", [(r["o_orderkey"], r["o_totalprice"]) for r in rows])
    con.commit()
    return con.serialize()


def order_files(spark: SparkSession, sf: str) -> DataFrame:
    """orders in sqlite files of 5,000 keys each."""
    root = scratch.new_folder(spark)
    root = root if "://" in root else root.replace("file:", "file://", 1)
    rows = table(spark, sf, "orders").select(*ORDER, (F.col("o_orderkey") / 5000).cast("int").alias("file"))
    written(rows, f"{root}/orders", as_orders, ORDER)
    return ranges.list_files(spark, f"{root}/orders")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n_orders, CAST(sum(o_orderkey % 1000) AS BIGINT) AS keys, CAST(max(o_orderkey // 1000) AS BIGINT) AS last_cluster, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey, o_orderpriority")
def sqlite_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """orders read from sqlite files in pieces of 400 rows, whose keys are far from even."""
    df = keyed.read_sqlite(spark, order_files(spark, sf), "orders", rows=400, step=65536)
    cluster = F.floor(F.col("o_orderkey") / F.lit(10**12))
    return df.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum(F.col("o_orderkey") % F.lit(10**12)).alias("keys"), F.max(cluster).alias("last_cluster"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query("SELECT CAST(o_orderkey // 5000 AS BIGINT) AS file, name, count(*) AS n_rows, count(*) > 400 AND name = 'orders' AS in_parts FROM orders, (VALUES ('orders'), ('prices')) t(name) GROUP BY o_orderkey // 5000, name")
def sqlite_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table of sqlite files, counted in pieces of 400 rows where the table has row keys."""
    found = keyed.table_counts(spark, order_files(spark, sf), rows=400)
    return found.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("file"), "name", "n_rows", (F.col("n_pieces") > 1).alias("in_parts"))


# profiles that read no table, or no table twice -----------------------------

#: Columns by the bounds they have: integers, times, floats, strings.
PROFILED = {
    "lineitem": {"l_orderkey": "whole", "l_linenumber": "whole", "l_quantity": "real", "l_extendedprice": "real", "l_returnflag": "text", "l_shipdate": "time"},
    "orders": {"o_orderkey": "whole", "o_custkey": "whole", "o_totalprice": "real", "o_orderstatus": "text", "o_orderpriority": "text", "o_orderdate": "time"},
    "events": {"event_id": "whole", "ts": "time", "user_id": "whole", "event_type": "text", "value": "real", "props": "text"},
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
}


def bounds_sql(name: str, kind: str) -> str:
    held = {"whole": name, "time": f"epoch_us({name})", "real": f"CASE WHEN NOT isnan({name}) THEN {name} END", "text": name}[kind]
    types = {"whole": "BIGINT", "real": "DOUBLE", "text": "VARCHAR"}
    return ", ".join(f"CAST({f'{fn}({held})' if b == kind.replace('time', 'whole') else 'NULL'} AS {t}) AS {side}_{b}" for b, t in types.items() for side, fn in (("low", "min"), ("high", "max")))


@query(unions([f"SELECT '{t}' AS of, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, {bounds_sql(c, kind)} FROM {t}" for t, columns in PROFILED.items() for c, kind in columns.items()]))
def profile_from_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, nulls and bounds of columns of four tables from their footers; columns without whole statistics (long texts) are scanned."""
    out = None
    for name, columns in PROFILED.items():
        one = footers.footer_profile(spark, f"{sf}/{name}.parquet").where(F.col("column").isin(*columns)).drop("from_footers").withColumn("of", F.lit(name))
        out = one if out is None else out.unionAll(one)
    return out


def moments_sql(name: str, kind: str) -> str:
    return f"round(avg({name}), 4) AS mean, round(stddev_pop({name}), 4) AS std" if kind in ("whole", "real") else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"


@query(unions([f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, {bounds_sql(c, kind)}, {moments_sql(c, kind)} FROM orders" for c, kind in PROFILED["orders"].items()]))
def profile_of_grown_folder(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of orders as it comes in three lots: each lot's files are scanned once, when they are new, and their states are merged."""
    root, rows = scratch.new_folder(spark), table(spark, sf, "orders")
    for lot in range(3):
        rows.where(F.col("o_orderkey") % 3 == lot).write.mode("append").parquet(f"{root}/orders")
        found = states.refresh(spark, f"{root}/orders", f"{root}/states")
    return found.select("column", "n_rows", "n_missing", *[f"{side}_{b}" for b in footers.BOUNDS for side in ("low", "high")], F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))
