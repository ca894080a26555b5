"""Command line: inspect files, recommend models, run probes.

Exit codes: 0 done; 2 bad input, or open assumptions with --strict-assumptions; 3 to 6 a
bundle that was made or given is invalid (recommendation, results, decision, requests).
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from siftwell.context import Options
from siftwell.plans import bundles
from siftwell.plans.inspect import Report, inspect


def session() -> SparkSession:
    spark = SparkSession.builder.appName("siftwell").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shown(r: Report) -> str:
    """A report as text; long summaries are cut."""
    lines = [f"== {r.display_name}", f"   {r.file_type} ({r.confidence:.0%}): {r.reason}", *[f"   ! {w}" for w in r.warnings], "   " + json.dumps(r.summary, ensure_ascii=False, default=str)[:6000]]
    if r.findings:
        lines.append(f"   vital_supported: {r.supported}/{len(r.findings)}")
        lines += [f"   [{f.status}] {f.key} ({f.confidence:.2f}): {f.summary[:170]}" for f in r.findings]
    if r.assumptions:
        sure = sum(a["status"] == "auto_accept" for a in r.assumptions)
        lines.append(f"   assumptions: auto_accept={sure}, verify_or_unresolved={len(r.assumptions) - sure}")
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("inspect", help="detect, summarise and diagnose files")
    p.add_argument("path")
    p.add_argument("--recursive", action="store_true")
    for name in ("target-col", "time-col", "split-col", "group-col", "task-hint", "objective-metric", "assumptions-out", "diagnostic-out"):
        p.add_argument(f"--{name}")
    p.add_argument("--id-col", action="append", default=[])
    p.add_argument("--auto-accept", type=float, default=Options.auto_accept)
    p.add_argument("--strict-assumptions", action="store_true")
    p = sub.add_parser("recommend", help="rank model families and decide on the next round")
    p.add_argument("--diagnostic-in", required=True)
    p.add_argument("--recommendation-out", required=True)
    for name in ("probe-results-in", "loop-decision-out", "probe-request-out", "diagnostic-normalized-out", "loop-run-id"):
        p.add_argument(f"--{name}")
    for name, value in (("max-candidates", 3), ("round-index", 1), ("max-rounds", 3), ("max-total-probes", 12), ("max-probes-per-dataset", 2)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--min-confidence-gain", type=float, default=0.02)
    p = sub.add_parser("probe", help="run (simulate) requested probes")
    p.add_argument("--probe-request-in", required=True)
    p.add_argument("--probe-result-out", required=True)
    return top


def failed(found: list[str], code: int) -> int:
    print("\n".join(found), file=sys.stderr)
    return code


def run_inspect(a: argparse.Namespace, spark: SparkSession) -> int:
    options = Options(target_column=a.target_col, time_column=a.time_col, split_column=a.split_col, group_column=a.group_col, id_columns=tuple(a.id_col), task_hint=a.task_hint, objective_metric=a.objective_metric, auto_accept=a.auto_accept)
    reports = inspect(spark, a.path, options, a.recursive)
    print("\n".join(map(shown, reports)))
    if a.assumptions_out:
        bundles.write_json(bundles.assumptions_file(reports, a.path), bundles.output_path(a.assumptions_out, "assumptions.json"))
    if a.diagnostic_out:
        bundles.write_json(bundles.diagnostic_bundle(spark, reports, a.path), bundles.output_path(a.diagnostic_out, "diagnostic_bundle.json"))
    return 2 if a.strict_assumptions and any(x["status"] != "auto_accept" for r in reports for x in r.assumptions) else 0


def run_recommend(a: argparse.Namespace, spark: SparkSession) -> int:
    diagnosis = json.loads(Path(a.diagnostic_in).expanduser().read_text())
    if isinstance(diagnosis, dict) and "files" in diagnosis and "schema_version" not in diagnosis:
        diagnosis = bundles.from_assumptions_file(spark, diagnosis)
    if found := bundles.errors(diagnosis, "diagnostic_bundle"):
        return failed(found, 2)
    if a.diagnostic_normalized_out:
        bundles.write_json(diagnosis, bundles.output_path(a.diagnostic_normalized_out, "diagnostic_bundle.json"))
    results = json.loads(Path(a.probe_results_in).expanduser().read_text()) if a.probe_results_in else None
    if results is not None and (found := bundles.errors(results, "probe_result_bundle")):
        return failed(found, 4)
    advice = bundles.recommendation_bundle(spark, diagnosis, a.max_candidates)
    if found := bundles.errors(advice, "recommendation_bundle"):
        return failed(found, 3)
    bundles.write_json(advice, bundles.output_path(a.recommendation_out, "recommendation_bundle.json"))
    limits = {"results": results, "loop_id": a.loop_run_id, "round_index": a.round_index, "max_rounds": a.max_rounds, "max_probes": a.max_total_probes, "min_gain": a.min_confidence_gain}
    decision = bundles.loop_decision_bundle(spark, advice, **limits)
    if found := bundles.errors(decision, "loop_decision_bundle"):
        return failed(found, 5)
    if a.loop_decision_out:
        bundles.write_json(decision, bundles.output_path(a.loop_decision_out, "loop_decision_bundle.json"))
    print(f"{decision['decision']['action']}: {decision['decision']['reason']}")
    if decision["decision"]["should_emit_probe_requests"] and a.probe_request_out:
        requests = bundles.probe_request_bundle(spark, diagnosis, advice, **(limits | {"loop_id": decision["loop_run_id"]}), per_dataset=a.max_probes_per_dataset)
        if found := bundles.errors(requests, "probe_request_bundle"):
            return failed(found, 6)
        bundles.write_json(requests, bundles.output_path(a.probe_request_out, "probe_request_bundle.json"))
    return 0


def run_probe(a: argparse.Namespace, spark: SparkSession) -> int:
    requests = json.loads(Path(a.probe_request_in).expanduser().read_text())
    if found := bundles.errors(requests, "probe_request_bundle"):
        return failed(found, 2)
    results = bundles.probe_result_bundle(spark, requests)
    if found := bundles.errors(results, "probe_result_bundle"):
        return failed(found, 3)
    bundles.write_json(results, bundles.output_path(a.probe_result_out, "probe_result_bundle.json"))
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return {"inspect": run_inspect, "recommend": run_recommend, "probe": run_probe}[a.command](a, session())


if __name__ == "__main__":
    sys.exit(main())
