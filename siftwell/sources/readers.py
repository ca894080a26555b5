"""Readers: from detected files to DataFrames of all their rows.

Formats that Spark reads are read by Spark.  The others are parsed on executors, file by
file, into JSON rows, whose schema is inferred once.  Nothing is unpickled.
"""

from __future__ import annotations

import bz2
import contextlib
import csv
import gzip
import io
import itertools
import json
import sqlite3
import tempfile
import urllib.parse
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import IO, Any
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources import split
from siftwell.sources.ranges import Ranged, list_files, tasks

Rows = Iterator[dict[str, Any]]


def as_file(source: bytes | Ranged) -> io.IOBase:
    """Something that can be read at any place."""
    if isinstance(source, Ranged):
        source.seek(0)
        return source
    return io.BytesIO(source)


def plain(value: Any) -> Any:
    """A value that JSON can hold."""
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, np.generic):
        value = value.item()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else value
    if isinstance(value, complex):
        return str(value)
    return value


def json_row(row: dict[str, Any]) -> str:
    return json.dumps({str(k): plain(v) for k, v in row.items()}, ensure_ascii=False, default=str)


def table_of(value: Any) -> Rows:
    """The rows of a list that holds objects only."""
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        yield from value


def json_rows(data: bytes) -> Rows:
    try:
        yield from table_of(json.loads(data))
    except ValueError:
        return


def yaml_rows(data: bytes) -> Rows:
    import yaml

    from siftwell.sources.detect import yaml_value

    try:
        yield from table_of(yaml_value(data.decode("utf-8", "replace")))
    except yaml.YAMLError:
        return


class Tables(HTMLParser):
    """Cells of all tables, row by row. Nested tables join the outer one's cell."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.heads: list[list[bool]] = []
        self.depth, self.cell, self.starts = 0, None, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.starts += 1
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
                self.heads.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
            self.heads[-1].append(True)
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.heads[-1][-1] &= tag == "th"
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif tag in ("td", "th", "tr") and self.depth == 1:
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell and self.depth and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] += data


def html_tables(text: str) -> tuple[int, list[tuple[list[str], list[list[str]]]]]:
    """How many table tags start, and (columns, rows) of the tables with cells."""
    parser = Tables()
    parser.feed(text)
    out = []
    for rows, heads in zip(parser.tables, parser.heads, strict=True):
        rows = [([c.strip() for c in r], h) for r, h in zip(rows, heads, strict=True) if r]
        if not rows:
            continue
        width = max(len(r) for r, _ in rows)
        names = rows[0][0] if rows[0][1] else [str(i) for i in range(width)]
        out.append(([*names, *[str(i) for i in range(len(names), width)]], [r for r, _ in (rows[1:] if rows[0][1] else rows)]))
    return parser.starts, out


def number_or_text(cell: str) -> Any:
    for make in (int, float):
        try:
            return make(cell)
        except ValueError:
            continue
    return {"true": True, "false": False}.get(cell.lower(), cell or None)


def html_rows(data: bytes, table: int = 0) -> Rows:
    _, tables = html_tables(data.decode("utf-8", "replace"))
    if table < len(tables):
        names, rows = tables[table]
        for r in rows:
            yield {n: number_or_text(c) for n, c in zip(names, r, strict=False)}


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_sheets(data: bytes | Ranged) -> list[tuple[str, list[list[Any]]]]:
    """(name, rows of cells) of each sheet, from the workbook's XML."""
    with zipfile.ZipFile(as_file(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = links.get(sheet.get(REL), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iter(f"{SHEET}row"):
                cells: list[Any] = []
                for cell in row.iter(f"{SHEET}c"):
                    at = 0
                    for letter in (c for c in cell.get("r", "") if c.isalpha()):
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * (at - 1 - len(cells))
                    value, kind = cell.find(f"{SHEET}v"), cell.get("t", "n")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter(f"{SHEET}t")))
                    elif value is None or value.text is None:
                        cells.append(None)
                    elif kind == "s":
                        cells.append(shared[int(value.text)])
                    elif kind == "b":
                        cells.append(value.text == "1")
                    else:
                        cells.append(value.text if kind in ("str", "e", "d") else number_or_text(value.text))
                rows.append(cells)
            out.append((sheet.get("name", ""), rows))
        return out


def xlsx_rows(data: bytes, sheet: int = 0) -> Rows:
    sheets = xlsx_sheets(data)
    if sheet < len(sheets) and sheets[sheet][1]:
        head, *rows = sheets[sheet][1]
        names = [str(h) if h is not None else f"Unnamed: {i}" for i, h in enumerate(head)]
        for r in rows:
            yield dict(zip(names, [*r, *[None] * (len(names) - len(r))], strict=False))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_open(data: bytes | Ranged) -> tuple[sqlite3.Connection, Any]:
    """A connection to a file, and what must stay open while it lives. A file that lies in a file system is read where it is; others are copied to the worker's temporary folder."""
    if isinstance(data, Ranged) and data.local:
        return sqlite3.connect(f"file:{urllib.parse.quote(data.local)}?mode=ro&immutable=1", uri=True), contextlib.nullcontext()
    held = tempfile.NamedTemporaryFile(suffix=".sqlite")
    held.write(data if isinstance(data, bytes) else data.range(0, data.size))
    held.flush()
    return sqlite3.connect(f"file:{held.name}?mode=ro", uri=True), held


def sqlite_tables(con: sqlite3.Connection) -> list[str]:
    """Tables by name, without those that sqlite keeps for itself."""
    return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite^_%' ESCAPE '^' ORDER BY name")]


def sqlite_rows(data: bytes | Ranged, table: str | None = None) -> Rows:
    con, held = sqlite_open(data)
    with held, contextlib.closing(con):
        names = sqlite_tables(con)
        if names:
            found = con.execute(f"SELECT * FROM {quoted(table or names[0])}")
            columns = [d[0] for d in found.description]
            for row in found:
                yield {c: plain(v) for c, v in zip(columns, row, strict=True)}


def npz_choice(shapes: dict[str, tuple[int, ...]]) -> tuple[str | None, str | None]:
    """The feature array (most cells of those with one or two dimensions) and the target (same rows, one column, likeliest name)."""
    flat = {k: int(np.prod(s)) for k, s in shapes.items() if len(s) in (1, 2) and all(x > 0 for x in s)}
    if not flat:
        return None, None
    feature = max(flat, key=flat.get)
    fits = [k for k, s in shapes.items() if k != feature and (s == (shapes[feature][0],) or s == (shapes[feature][0], 1))]

    def likely(name: str) -> int:
        low = name.lower()
        return 5 * any(t in low for t in ("y", "target", "label", "outcome", "response")) + 2 * any(t in low for t in ("unstable", "status", "class"))

    return feature, max(fits, key=likely) if fits else None


def npz_rows(data: bytes | Ranged) -> Rows:
    with np.load(as_file(data), allow_pickle=False) as arrays:
        feature, target = npz_choice({k: arrays[k].shape for k in arrays.files})
        if feature is None:
            return
        x = arrays[feature].reshape(len(arrays[feature]), -1)
        y = arrays[target].reshape(-1) if target else None
        for i, row in enumerate(x):
            out = {f"f{j}": plain(v) for j, v in enumerate(row)}
            if y is not None:
                out[target] = plain(y[i])
            yield out


def xml_rows(data: bytes) -> Rows:
    """Children of the root as rows: attributes and texts of their children."""
    for child in ElementTree.fromstring(data):
        row: dict[str, Any] = {f"_{k}": number_or_text(v) for k, v in child.attrib.items()}
        for leaf in child:
            row[leaf.tag.rsplit("}", 1)[-1]] = number_or_text((leaf.text or "").strip())
        yield row


PARSERS: dict[str, Callable[[bytes], Rows]] = {"json": json_rows, "yaml": yaml_rows, "html": html_rows, "xlsx": xlsx_rows, "sqlite": sqlite_rows, "npz": npz_rows, "xml": xml_rows}


def parsed(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The rows of a file of a format that Spark doesn't read; None if it holds no table. Files are parsed once: their rows are kept as a table, which their types and whatever follows read."""
    make = PARSERS[kind]

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Ranged(name, data) as file:
                    rows = make(file if kind in ("xlsx", "sqlite", "npz") else file.range(0, file.size))
                    while held := [json_row(r) for r in itertools.islice(rows, 4096)]:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return from_json_rows(split.kept(list_files(spark, path).select("path", "content").mapInArrow(parse, "value string")))


def from_json_rows(rows: DataFrame) -> DataFrame | None:
    """Rows of JSON objects as columns, of the schema that fits them all; None without objects."""
    spark = rows.sparkSession
    found = DataFrame(spark.read._jreader.json(split.strings(rows.select("value"))), spark)
    return found if found.columns else None


#: Encodings by name: how Spark calls them, and whether each byte of a quote or line end stands for itself.
ENCODINGS = {"utf-8": ("UTF-8", True), "utf-8-sig": ("UTF-8", True), "utf-16": ("UTF-16", False), "latin-1": ("ISO-8859-1", True)}


def csv_options(details: dict[str, str], kind: str) -> dict[str, str]:
    """How Spark must read a delimited file."""
    encoding = ENCODINGS.get(details.get("encoding", ""), ENCODINGS["utf-8"])[0]
    return {"header": "true", "inferSchema": "true", "sep": details.get("delimiter") or {"tsv": "\t"}.get(kind, ","), "quote": '"', "escape": '"', "encoding": encoding}


def holds_quotes(spark: SparkSession, path: str) -> bool:
    return bool(spark.read.text(path).where(F.contains("value", F.lit('"'))).limit(1).count())


def delimited_table(spark: SparkSession, path: str, kind: str, details: dict[str, str]) -> DataFrame:
    """A delimited file's table. Without quotes Spark may cut it at any line end; with quotes, which may hold line ends, it is cut by ``split``.
    Whole files are read by one task only if they are compressed, of wide characters, or in stores that only Spark's readers open."""
    options, encoding = csv_options(details, kind), details.get("encoding") or "utf-8"
    whole = options | {"multiLine": "true"}
    if path.lower().endswith((".gz", ".bz2")) or not ENCODINGS.get(encoding, ("", False))[1]:
        return spark.read.options(**whole).csv(path)
    if details.get("quoted") != "true" and encoding != "utf-8-sig" and not holds_quotes(spark, path):
        return spark.read.options(**options).csv(path)
    files = list_files(spark, path)
    if files.where("content IS NOT NULL").limit(1).count():
        return spark.read.options(**whole).csv(path)
    return split.read_csv(spark, files, options, "utf-8" if encoding == "utf-8-sig" else encoding)


def read_table(spark: SparkSession, path: str, kind: str, details: dict[str, str] | None = None) -> DataFrame | None:
    """The table that a file of this format holds, or None. details: delimiter, encoding and whether quotes occur, as summaries find them."""
    if kind in ("csv", "tsv", "delimited"):
        return delimited_table(spark, path, kind, details or {})
    if kind == "jsonl":
        df = spark.read.option("mode", "DROPMALFORMED").json(path)
        return df if df.columns else None
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        files = list_files(spark, path)
        if not files.where("content IS NOT NULL").limit(1).count():
            return split.read_json(spark, files)
    if kind == "sqlite":
        from siftwell.sources import keyed

        files = list_files(spark, path)
        if not files.where("content IS NOT NULL OR NOT (path LIKE 'file:/%' OR path LIKE '/%')").limit(1).count():
            return keyed.read_sqlite(spark, files)
    if kind in PARSERS:
        return parsed(spark, path, kind)
    return None


def inner_name(name: str) -> str:
    """The name of what a compressed file holds."""
    stem = name.rsplit(".", 1)[0] if name.rsplit(".", 1)[-1].lower() in ("gz", "bz2", "bzip2") else name
    return f"{name}::{stem.rsplit('/', 1)[-1]}"


def members(name: str, source: bytes | Ranged, most: int | None = None) -> Iterator[tuple[str, bytes]]:
    """The members of a zip, or the content of a gzip or bzip2 file, one by one, whole or of at most ``most`` bytes; not containers: nothing."""
    magic = as_file(source).read(4)
    if magic.startswith(b"PK"):
        with zipfile.ZipFile(as_file(source)) as z:
            for info in z.infolist():
                if not info.is_dir() and (most is None or info.file_size <= most):
                    yield f"{name}::{info.filename}", z.read(info)
    for sign, opened in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open)):
        if magic.startswith(sign):
            with opened(as_file(source)) as f:
                yield inner_name(name), f.read() if most is None else f.read(most)


def unpacked(name: str, data: bytes | Ranged, most: int = 10 * 1024 * 1024, count: int = 20) -> list[tuple[str, bytes]]:
    """The first ``count`` members of at most ``most`` bytes, for summaries."""
    return list(itertools.islice(members(name, data, most), count))


def delimited_rows(stream: IO[bytes], delimiter: str, encoding: str) -> Rows:
    lines = csv.reader(io.TextIOWrapper(stream, encoding, "replace", newline=""), delimiter=delimiter)
    head = next(lines, [])
    for row in lines:
        if row:
            yield {h: number_or_text(c) for h, c in zip(head, [*row, *[""] * (len(head) - len(row))], strict=False)}


def line_rows(stream: IO[bytes]) -> Rows:
    for line in io.TextIOWrapper(stream, "utf-8", "replace"):
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            yield value


def stream_rows(name: str, opened: Callable[[], IO[bytes]], sniff: int, levels: int = 2) -> Iterator[tuple[str, dict[str, Any]]]:
    """(member, row) of a member that can be opened as a stream, if it holds a table; containers inside are opened too. Lines are read as they come, other formats whole."""
    from siftwell.sources.detect import detect
    from siftwell.sources.structure import decode

    with opened() as stream:
        head = stream.read(sniff)
        whole = len(head) < sniff or not stream.read(1)
    kind = detect(name, head, whole)
    if kind.file_type in ("zip", "gzip", "bzip2", "npz", "xlsx"):
        # the directory of an archive stands at its end
        with opened() as stream:
            content = stream.read()
        kind = detect(name, content, True)
        if kind.file_type in ("zip", "gzip", "bzip2"):
            found = (member_rows(name, content, sniff, levels - 1) if levels > 1 else iter(()))
            yield from found
            return
    with opened() as stream:
        if kind.file_type in ("csv", "tsv", "delimited"):
            rows = delimited_rows(stream, kind.details.get("delimiter", ","), decode(head)[1])
        elif kind.file_type == "jsonl":
            rows = line_rows(stream)
        else:
            rows = PARSERS[kind.file_type](stream.read()) if kind.file_type in PARSERS else iter(())
        yield from ((name, r) for r in rows)


def member_rows(name: str, data: bytes, sniff: int, levels: int = 2) -> Iterator[tuple[str, dict[str, Any]]]:
    """(member, row) of the first member of a container at hand that holds a table."""
    for inner, content in members(name, data):
        rows = stream_rows(inner, lambda content=content: io.BytesIO(content), sniff, levels)
        first = next(rows, None)
        if first is not None:
            yield first
            yield from rows
            return


ENTRY = "path string, member string, place long, at long, packed long, size long, method int, crc long, flags int"


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each member of zip files, from their directories alone: place in the directory, where it begins, packed and whole size, method."""

    def look(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Ranged(name, data) as file, zipfile.ZipFile(file) as z:
                    entries = [(name, e.filename, i, e.header_offset, e.compress_size, e.file_size, e.compress_type, e.CRC, e.flag_bits) for i, e in enumerate(z.infolist()) if not e.is_dir()]
                columns = list(zip(*entries, strict=True)) or [()] * 9
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "member", "place", "at", "packed", "size", "method", "crc", "flags"])

    return list_files(spark, path).select("path", "content").mapInArrow(look, ENTRY)


class Inflated(io.RawIOBase):
    """The content of one member, unpacked as it is read, from the range that holds it; stored and deflated members only."""

    def __init__(self, path: str, at: int, packed: int, method: int, crc: int, step: int = 1 << 18) -> None:
        super().__init__()
        self.file, self.step, self.crc, self.want = Ranged(path), step, 0, crc
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"Compression method {method} isn't read.")
        head = self.file.range(at, at + 30)
        # the local header repeats the name and has its own extra field; their lengths are its last numbers
        self.at = at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        self.stop = self.at + packed
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self.held = b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held and self.at < self.stop or not self.held and self.inflate and self.inflate.unconsumed_tail:
            if self.inflate and self.inflate.unconsumed_tail:
                self.held = self.inflate.decompress(self.inflate.unconsumed_tail, self.step)
                continue
            got = self.file.range(self.at, min(self.stop, self.at + self.step))
            if not got:
                break
            self.at += len(got)
            self.held = self.inflate.decompress(got, self.step) if self.inflate else got
        given, self.held = self.held[: len(into)], self.held[len(into) :]
        self.crc = zlib.crc32(given, self.crc)
        if not given and self.crc != self.want:
            raise zipfile.BadZipFile("The member's checksum differs.")
        into[: len(given)] = given
        return len(given)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def entry_rows(entries: DataFrame, sniff: int = 256 * 1024, most: int | None = None) -> DataFrame:
    """(path, member, place, inner, value): the rows of every member (of zip_entries) that holds a table, as JSON; each member is opened, unpacked and parsed by itself, so members spread over tasks.
    ``inner``: the member inside of a member where containers are nested. A member that can't be read gives one row without a value. most: rows a member, if only some are wanted."""

    def parse(batches):
        for batch in batches:
            for e in batch.to_pylist():
                rows = stream_rows(f"{e['path']}::{e['member']}", lambda e=e: io.BufferedReader(Inflated(e["path"], e["at"], e["packed"], e["method"], e["crc"])), sniff)
                rows = itertools.islice(rows, most)
                try:
                    while held := list(itertools.islice(rows, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([e["path"]] * len(held)), pa.array([e["member"]] * len(held)), pa.array([e["place"]] * len(held), pa.int64()), pa.array([m for m, _ in held], pa.string()), pa.array([json_row(r) for _, r in held], pa.string())], names=["path", "member", "place", "inner", "value"])
                except (ValueError, OSError, zipfile.BadZipFile, zlib.error):
                    yield pa.RecordBatch.from_arrays([pa.array([e["path"]]), pa.array([e["member"]]), pa.array([e["place"]], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string())], names=["path", "member", "place", "inner", "value"])

    size = entries.agg(F.count("*").alias("n"), F.sum("packed").alias("total")).first()
    dealt = entries.repartition(tasks(size.n, size.total or 0), "path", "place")
    return dealt.mapInArrow(parse, "path string, member string, place long, inner string, value string")


def container_table(spark: SparkSession, path: str, sniff: int) -> tuple[str, DataFrame] | None:
    """The name of the first member with a table, and its rows, whatever their size; unpacked and parsed on executors."""
    files = list_files(spark, path)
    if path.lower().endswith(".zip") and not files.where("content IS NOT NULL").limit(1).count():
        entries = zip_entries(spark, path)
        first = entry_rows(entries, sniff, 1).where("value IS NOT NULL").agg(F.min(F.struct("path", "place", "inner")).alias("m")).first().m
        if first is None:
            return None
        df = from_json_rows(entry_rows(entries.where((F.col("path") == first.path) & (F.col("place") == first.place)), sniff).where("value IS NOT NULL").select("value"))
        return (first.inner, df) if df is not None else None

    def parse(batches):
        for batch in batches:
            for name, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with Ranged(name, data) as file:
                    sign = file.read(4)
                    if sign.startswith(b"PK"):
                        rows = member_rows(name, file.range(0, file.size), sniff)
                    else:
                        opened = gzip.open if sign.startswith(b"\x1f\x8b") else bz2.open
                        rows = stream_rows(inner_name(name), lambda opened=opened, name=name, data=data: opened(Ranged(name, data)), sniff)
                    while held := list(itertools.islice(rows, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.string()), pa.array([json_row(r) for _, r in held], pa.string())], names=["member", "value"])

    rows = files.select("path", "content").mapInArrow(parse, "member string, value string")
    first = rows.select("member").first()
    df = from_json_rows(rows.select("value")) if first else None
    return (first.member, df) if df is not None else None
