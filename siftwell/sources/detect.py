"""Format detection from a name and the first bytes of a file.

Rules run in a fixed order, cheap ones first; the first that holds decides.  ``detect`` is
a plain function of bytes, run on executors in Arrow batches by ``detect_files`` (files in
a folder) and ``detect_column`` (texts of a table).
"""

from __future__ import annotations

import configparser
import csv
import io
import json
import re
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.ranges import Ranged, list_files

SCHEMA = "file_type string, confidence double, reason string, details map<string,string>"

# Signatures and suffixes of formats, with the confidence of each.
MAGIC = (
    ("gzip", 0.95, b"\x1f\x8b", (".gz",)),
    ("bzip2", 0.95, b"BZh", (".bz2", ".bzip2")),
    ("sqlite", 0.95, b"SQLite format 3\x00", (".sqlite", ".db", ".sqlite3")),
    ("parquet", 0.9, b"PAR1", (".parquet",)),
)
EXCEL = (".xlsx", ".xlsm", ".xltx", ".xltm")
BINARY_SUFFIXES = {".pkl": "pickle", ".pickle": "pickle", ".feather": "feather", ".avro": "avro"}
DELIMITERS = (",", "\t", ";", "|")
PREFERRED = {".csv": ",", ".tsv": "\t", ".tab": "\t", ".psv": "|"}
# The forms of a key with its value and of a number.
KEY_VALUE = re.compile(r"^\s*[A-Za-z0-9_.\-]+\s*[:=]\s*.+$")
CELL = re.compile(r"^[+\-]?(\d+(\.\d+)?|\.\d+)$")
PRINTABLE = bytes([*range(9, 14), *range(32, 127)])
BEYOND = bytes(range(128, 256))


@dataclass(frozen=True)
class Detection:
    file_type: str
    confidence: float
    reason: str
    details: dict[str, str] = field(default_factory=dict)


def suffix_of(name: str) -> str:
    base = name.rsplit("/", 1)[-1].rsplit("::", 1)[-1]
    return f".{base.rsplit('.', 1)[1].lower()}" if "." in base.strip(".") else ""


def solid_lines(text: str, most: int) -> list[str]:
    out = []
    for line in text.splitlines():
        if line.strip():
            out.append(line)
            if len(out) == most:
                break
    return out


def parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def zip_kind(file: io.IOBase, suffix: str) -> Detection:
    """The format of an archive, from its directory alone."""
    try:
        with zipfile.ZipFile(file) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
    except (zipfile.BadZipFile, OSError):
        names = []
    if names and all(n.endswith(".npy") for n in names):
        return Detection("npz", 0.97 if suffix == ".npz" else 0.88, "archive of arrays only")
    if "[Content_Types].xml" in names and any(n.startswith("xl/") for n in names):
        return Detection("xlsx", 0.95, "archive with a workbook")
    if suffix == ".npz":
        return Detection("npz", 0.85, "suffix only")
    return Detection("zip", 0.9, "archive")


def json_lines(text: str, whole: bool = True) -> bool:
    """Whether at least four in five of the first lines are JSON; a line that is cut off doesn't count."""
    lines = solid_lines(text if whole else text[: text.rfind("\n") + 1], 20)
    if len(lines) < 2:
        return False
    return sum(map(parses, lines)) >= max(2, int(0.8 * len(lines)))


def yaml_value(text: str) -> Any:
    """The value of a YAML text, by the parser in C where there is one; plain values only."""
    import yaml

    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506  a safe loader


def yaml_loads(text: str) -> bool:
    try:
        import yaml
    except ImportError:
        return False
    try:
        return yaml_value(text) is not None
    except (yaml.YAMLError, ValueError):
        return False


def looks_like_yaml(text: str) -> bool:
    return text.lstrip().startswith("---") or bool(re.search(r"^\w[\w\-]*:\s+", text, re.M)) or bool(re.search(r"^\-\s+\w", text, re.M))


def ini_loads(text: str) -> bool:
    try:
        parser = configparser.ConfigParser()
        parser.read_string(text)
    except (configparser.Error, UnicodeError):
        return False
    return bool(parser.sections())


def widths(lines: list[str], delimiter: str) -> list[int]:
    try:
        return [len(row) for row in csv.reader(lines, delimiter=delimiter)]
    except csv.Error:
        return []


def delimited(text: str, suffix: str) -> dict[str, str] | None:
    """Delimiter, columns and header guess, or None. The best width times consistency wins, the preferred delimiter first."""
    lines = solid_lines(text, 50)
    if len(lines) < 2:
        return None
    best, best_score = None, 0.0
    first = PREFERRED.get(suffix)
    for d in [first, *[x for x in DELIMITERS if x != first]] if first else DELIMITERS:
        sizes = widths(lines, d)
        if not sizes:
            continue
        width, times = min(Counter(sizes).items(), key=lambda x: (-x[1], -x[0]))
        share = times / len(sizes)
        if width >= 2 and share >= 0.8 and width * share > best_score:
            best, best_score = (d, width, share), width * share
    if best is None:
        try:
            d = csv.Sniffer().sniff("\n".join(lines)).delimiter
        except csv.Error:
            return None
        sizes = widths(lines, d)
        if not sizes or max(sizes) < 2 or d.isalnum() or d.isspace() and d != "\t":
            return None
        best = (d, Counter(sizes).most_common(1)[0][0], 0.0)
    head, second = (next(csv.reader([x], delimiter=best[0])) for x in lines[:2])
    numbers = [sum(bool(CELL.match(c.strip())) for c in row) for row in (head, second)]
    return {"delimiter": best[0], "columns": str(best[1]), "consistency": f"{best[2]:.3f}", "has_header": str(numbers[0] < numbers[1]).lower()}


def key_values(text: str) -> bool:
    lines = solid_lines(text, 50)
    return len(lines) >= 3 and sum(bool(KEY_VALUE.match(x)) for x in lines) >= 0.6 * len(lines)


def tagged(text: str) -> bool:
    """Whether HTML tags stand among the first characters."""
    head = text.lstrip()[:2048].lower()
    return "<html" in head or "<table" in head


def printable(data: bytes) -> bool:
    """Whether at most three bytes in ten aren't printable ASCII; in texts with HTML tags letters of any language are printable too."""
    if len(data.translate(None, PRINTABLE)) <= 0.3 * len(data):
        return True
    text = data.decode("utf-8", "ignore")
    held = text.encode()
    return tagged(text) and len(data) - len(held) + len(held.translate(None, PRINTABLE + BEYOND)) <= 0.3 * len(data)


def detect(name: str, data: bytes, whole: bool = True, file: io.IOBase | None = None) -> Detection:
    """The format of data, the first bytes of the file ``name`` (all of them if whole); file: where more can be read."""
    suffix = suffix_of(name)
    for kind, sure, magic, suffixes in MAGIC:
        if data.startswith(magic) or suffix in suffixes:
            return Detection(kind, sure, "signature" if data.startswith(magic) else "suffix")
    if data.startswith(b"PK") or suffix in (".zip", ".npz"):
        return zip_kind(file or io.BytesIO(data), suffix)
    if suffix in EXCEL:
        return Detection("xlsx", 0.9, "suffix")
    if b"\x00" in data or not printable(data):
        kind = BINARY_SUFFIXES.get(suffix)
        return Detection(kind, 0.8, "binary with a known suffix") if kind else Detection("binary", 0.7, "mostly not printable")
    text = data.decode("utf-8", "replace")
    head = text.lstrip()
    if suffix in (".jsonl", ".ndjson") and json_lines(text, whole):
        return Detection("jsonl", 0.95, "lines of JSON and suffix")
    if head[:1] in ("{", "[") or suffix == ".json":
        if parses(text):
            return Detection("json", 0.95 if suffix == ".json" else 0.85, "parses as JSON")
    if json_lines(text, whole):
        return Detection("jsonl", 0.85, "lines of JSON")
    if not whole and suffix == ".json" and head[:1] in ("{", "["):
        # a cut value can't parse; it is no lines of JSON, starts like JSON and has the suffix
        return Detection("json", 0.95, "starts as JSON")
    if suffix in (".yaml", ".yml") and yaml_loads(text):
        return Detection("yaml", 0.95, "parses as YAML, and suffix")
    if looks_like_yaml(text) and yaml_loads(text):
        return Detection("yaml", 0.75, "parses as YAML")
    if head.startswith("<?xml") or head.startswith("<") and suffix == ".xml":
        try:
            ElementTree.fromstring(text)
            return Detection("xml", 0.9, "parses as XML")
        except ElementTree.ParseError:
            if not whole and suffix == ".xml":
                return Detection("xml", 0.9, "starts as XML")
    if tagged(text) or suffix in (".html", ".htm"):
        return Detection("html", 0.8, "HTML tags or suffix")
    if (suffix == ".ini" or re.search(r"^\s*\[[^\]]+\]\s*$", text, re.M)) and ini_loads(text):
        return Detection("ini", 0.95 if suffix == ".ini" else 0.8, "parses as INI")
    found = delimited(text, suffix)
    if found:
        kind = {",": "csv", "\t": "tsv", ";": "csv"}.get(found["delimiter"], "delimited")
        return Detection(kind, 0.95 if suffix in PREFERRED else 0.8, "lines of equal width", found)
    if key_values(text):
        return Detection("text_kv", 0.65, "lines of keys and values")
    return Detection("text", 0.55, "text")


def detected(rows: DataFrame, name: Column, data: Column, sniff: int | None) -> DataFrame:
    """rows with file_type, confidence, reason, details, from the first sniff bytes or, without a number, from all."""

    def look(batches):
        for batch in batches:
            n = batch.num_columns
            names, sizes, heads = (batch.column(n - k).to_pylist() for k in (3, 2, 1))
            got = [detect(a, h, sniff is None or size <= sniff) for a, size, h in zip(names, sizes, heads, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array([g.file_type for g in got], pa.string()), pa.array([g.confidence for g in got], pa.float64()), pa.array([g.reason for g in got], pa.string()), pa.array([list(g.details.items()) for g in got], pa.map_(pa.string(), pa.string()))], names=[*batch.schema.names[:-3], "file_type", "confidence", "reason", "details"])

    sent = rows.withColumns({"_name": F.coalesce(name, F.lit("")), "_size": F.coalesce(F.octet_length(data), F.lit(0)).cast("long"), "_head": F.coalesce(data if sniff is None else F.substring(data, 1, sniff), F.lit(b""))})
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], SCHEMA])
    return sent.mapInArrow(look, schema)


def detect_files(spark: SparkSession, path: str, recursive: bool = False, sniff: int = 256 * 1024) -> DataFrame:
    """(path, length, file_type, confidence, reason, details, n_read), ordered by path; n_read: the bytes that were read to tell."""

    def look(batches):
        for batch in batches:
            found, reads = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with Ranged(name, data) as file:
                    found.append(detect(name, file.range(0, sniff), file.size <= sniff, file))
                    reads.append(file.n_read)
            made = [pa.array([g.file_type for g in found], pa.string()), pa.array([g.confidence for g in found], pa.float64()), pa.array([g.reason for g in found], pa.string()), pa.array([list(g.details.items()) for g in found], pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made, pa.array(reads, pa.int64())], names=["path", "length", "file_type", "confidence", "reason", "details", "n_read"])

    return list_files(spark, path, recursive).mapInArrow(look, f"path string, length long, {SCHEMA}, n_read long").orderBy("path")


def detect_column(df: DataFrame, text: str, name: Column | None = None, sniff: int | None = None) -> DataFrame:
    """df without the text, with the format that each whole text has by itself."""
    return detected(df, name if name is not None else F.lit(""), F.col(text).cast("binary"), sniff).drop(text)
