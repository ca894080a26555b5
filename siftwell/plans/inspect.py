"""Inspection of files: detect, summarise, read the table inside, diagnose it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from siftwell.context import Options
from siftwell.plans.diagnose import CHECKS, Finding, assumptions, diagnose
from siftwell.sources import detect, readers, structure

TABULAR = ("csv", "tsv", "delimited", "json", "jsonl", "yaml", "xlsx", "sqlite", "html", "npz", "xml", "parquet")


@dataclass
class Report:
    display_name: str
    file_type: str
    confidence: float
    reason: str
    summary: dict[str, Any]
    warnings: list[str] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)
    assumptions: list[dict[str, Any]] = field(default_factory=list)
    profile: dict[str, Any] = field(default_factory=dict)

    @property
    def supported(self) -> int:
        return sum(f.status == "supported" for f in self.findings)


def table_of(spark: SparkSession, path: str, kind: str, details: dict[str, str], options: Options, summary: dict[str, Any]) -> tuple[DataFrame | None, list[str]]:
    """The table of a file, and notes; of a container the table of its first member that has one."""
    if kind in TABULAR:
        return readers.read_table(spark, path, kind, details | ({"encoding": summary["encoding"]} if summary.get("encoding") else {})), []
    if kind in ("gzip", "bzip2", "zip"):
        inner = next(iter(summary.get("members") or []), {})
        if path.lower().endswith((".gz", ".bz2")) and inner.get("file_type") in ("csv", "tsv", "delimited", "jsonl"):
            # Spark opens these itself; compressed files are read whole anyway, so quotes may span lines
            told = {k: str(inner["summary"][k]) for k in ("delimiter", "encoding") if inner["summary"].get(k)}
            return readers.read_table(spark, path, inner["file_type"], told | {"quoted": "true"}), [f"The table comes from '{inner['name']}'."]
        if found := readers.container_table(spark, path, options.sniff_bytes):
            return found[1].persist(), [f"The table comes from '{found[0]}'."]
    return None, []


def rows_at_hand(spark: SparkSession, summary: dict[str, Any]) -> DataFrame | None:
    """The rows that a summary shows, as a table; None if it shows none."""
    rows = [r for r in summary.get("sample_rows") or summary.get("sample_items") or [] if isinstance(r, dict) and r]
    return readers.from_json_rows(spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "value string")) if rows else None


def report_of(spark: SparkSession, row: Any, options: Options) -> Report:
    summary, notes = json.loads(row.summary), list(row.warnings or [])
    out = Report(row.path, row.file_type, row.confidence, row.reason, summary, notes)
    try:
        try:
            df, more = table_of(spark, row.path, row.file_type, dict(row.details or {}), options, summary)
            out.findings = diagnose(df, options)
        except Exception as e:  # noqa: BLE001  a table that can't be read may still have rows in the summary
            df = rows_at_hand(spark, summary)
            if df is None:
                raise
            more = [f"The table can't be read whole ({type(e).__name__}); diagnostics use the rows of the summary."]
            out.findings = diagnose(df, options)
        out.warnings += more
        if df is not None:
            npz = summary.get("tabular_preview") if row.file_type == "npz" else None
            out.assumptions = assumptions(out.findings, options, npz)
            size = out.findings[3].evidence
            out.profile = {"rows_profiled": size.get("n_rows_sampled", 0), "columns_profiled": len(df.columns[: options.max_columns]), "columns": df.columns[: options.max_columns]}
            df.unpersist()
    except Exception as e:  # noqa: BLE001  one bad file must not end the inspection of the others
        out.warnings.append(f"Diagnostics failed: {type(e).__name__}: {str(e)[:200]}")
        out.findings = [Finding(k, summary="Diagnostics failed.") for k in CHECKS]
    return out


def inspect(spark: SparkSession, path: str, options: Options = Options(), recursive: bool = False) -> list[Report]:
    """A report for each file, ordered by path. Files are detected and summarised on executors; each table is then read by Spark."""
    rows = structure.summarise_files(detect.list_files(spark, path, recursive), options).orderBy("path").collect()
    return [report_of(spark, r, options) for r in rows]


def inspect_table(df: DataFrame, name: str, options: Options = Options()) -> Report:
    """The report of a DataFrame."""
    out = Report(name, "dataframe", 1.0, "given", {"format": "dataframe", "columns": df.columns})
    out.findings = diagnose(df, options)
    out.assumptions = assumptions(out.findings, options)
    out.profile = {"rows_profiled": out.findings[3].evidence.get("n_rows_sampled", 0), "columns_profiled": len(df.columns), "columns": df.columns}
    return out
