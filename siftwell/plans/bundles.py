"""JSON bundles around the decisions: diagnostic, recommendation, loop decision, probe requests, probe results.

Decisions are made by ``decide`` on DataFrames; here rows become documents with ids,
hashes and time stamps, and documents become rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions import payload_hash
from siftwell.plans import decide
from siftwell.plans.inspect import Report

VERSION = "0.1.0"
Bundle = dict[str, Any]


def envelope(kind: str, prefix: str, producer: str) -> Bundle:
    return {"schema_version": f"{kind}.v1", "run_id": f"{prefix}_{uuid.uuid4().hex[:12]}", "generated_at_utc": datetime.now(UTC).isoformat(), "producer": {"name": f"siftwell.{producer}", "version": VERSION}}


def fingerprint(path: str) -> Bundle:
    """What tells a local file or folder from its other states. Paths that only Spark opens are missing here."""
    p = Path(path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path)
    if not p.exists():
        return {"kind": "missing", "path": str(path)}
    if p.is_dir():
        stats = [f.stat() for f in p.rglob("*") if f.is_file()]
        size, newest = sum(s.st_size for s in stats), max((s.st_mtime_ns for s in stats), default=0)
        digest = hashlib.sha256(f"dir|{len(stats)}|{size}|{newest}".encode()).hexdigest()
        return {"kind": "directory", "path": str(path), "file_count": len(stats), "total_size_bytes": size, "newest_mtime_ns": newest, "fingerprint_sha256": digest}
    stat, chunk = p.stat(), 1 << 20
    with p.open("rb") as f:
        head = f.read(chunk)
        f.seek(max(0, stat.st_size - chunk))
        tail = f.read(chunk)
    facts = {"size_bytes": stat.st_size, "mtime_ns": stat.st_mtime_ns, "head_sha256": hashlib.sha256(head).hexdigest(), "tail_sha256": hashlib.sha256(tail).hexdigest()}
    return {"kind": "file", "path": str(path), **facts, "fingerprint_sha256": hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()}


def shown(value: Any) -> str | None:
    return None if value is None else str(value)


def unit(value: Any) -> float:
    """A confidence as a number in [0, 1], 0 if it is none."""
    try:
        return round(min(1.0, max(0.0, float(value))), 3)
    except (TypeError, ValueError):
        return 0.0


STATUSES = {"supported", "needs_input", "unsupported"}
STATES = {"auto_accept", "needs_user_verification", "unresolved"}


def dataset_rows(spark: SparkSession, datasets: list[Bundle]) -> DataFrame:
    """Rows of ``decide.DATASET`` from dataset documents; unknown statuses become the weakest one."""
    rows = []
    for d in datasets:
        a = [(str(x.get("key", "")), shown(x.get("value")), unit(x.get("confidence")), x.get("status") if x.get("status") in STATES else "unresolved", str(x.get("source", "")), [str(e) for e in x.get("evidence") or []], str(x.get("risk_if_wrong", ""))) for x in d.get("assumptions") or []]
        f = [(str(x.get("key", "")), str(x.get("title", "")), x.get("status") if x.get("status") in STATUSES else "needs_input", unit(x.get("confidence")), str(x.get("summary", "")), json.dumps(x.get("evidence") or {}, default=str), [str(w) for w in x.get("warnings") or []]) for x in d.get("vital_findings") or []]
        coverage = d.get("coverage") or {}
        rows.append((str(d.get("dataset_id", "")), str(d.get("display_name", "")), str(d.get("detected_type", "unknown")), float(d.get("detection_confidence") or 0.0), int(coverage.get("supported_vital_checks") or 0), int(coverage.get("total_vital_checks") or 12), a, f, [str(w) for w in d.get("warnings") or []]))
    return spark.createDataFrame(rows, decide.DATASET)


def decided_rows(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """Rows of a diagnostic bundle with the readiness that it states."""
    datasets = bundle.get("datasets") or []
    stated = spark.createDataFrame([(str(d.get("dataset_id", "")), str(d.get("readiness_state", "")), [str(x) for x in d.get("blocking_reasons") or []], [str(x) for x in d.get("required_user_actions") or []], float(d.get("confidence_score") or 0.0)) for d in datasets], "dataset_id string, readiness_state string, blocking_reasons array<string>, required_user_actions array<string>, confidence_score double")
    return dataset_rows(spark, datasets).join(stated, "dataset_id")


def diagnostic_bundle(spark: SparkSession, reports: list[Report], path: str) -> Bundle:
    datasets = []
    for i, r in enumerate(reports):
        datasets.append({
            "dataset_id": f"ds_{i + 1:03d}", "display_name": r.display_name, "detected_type": r.file_type, "detection_confidence": r.confidence, "input_fingerprint": fingerprint(r.display_name),
            "coverage": {"supported_vital_checks": r.supported, "total_vital_checks": len(r.findings) or 12}, "dataset_profile": r.profile, "vital_findings": [f.to_dict() for f in r.findings], "assumptions": r.assumptions, "warnings": r.warnings,
        })
    ready = decide.readiness(dataset_rows(spark, datasets))
    by = {x.dataset_id: x for x in ready.select("dataset_id", "readiness_state", "blocking_reasons", "required_user_actions", "confidence_score").collect()}
    for d in datasets:
        d |= {k: by[d["dataset_id"]][k] for k in ("readiness_state", "blocking_reasons", "required_user_actions", "confidence_score")}
    return envelope("diagnostic_bundle", "diag", "inspect") | {"input": {"path": path, "fingerprint": fingerprint(path)}, "summary": decide.bundle_summary(ready).first().asDict(), "datasets": datasets}


def assumptions_file(reports: list[Report], path: str) -> Bundle:
    """The older document: assumptions by file."""
    files = [{"display_name": r.display_name, "detected_type": r.file_type, "assumptions": r.assumptions} for r in reports]
    return {"generated_at_utc": datetime.now(UTC).isoformat(), "input_path": path, "summary": {"file_count": len(files), "assumptions_needing_verification": sum(a["status"] != "auto_accept" for r in reports for a in r.assumptions)}, "files": files}


def from_assumptions_file(spark: SparkSession, old: Bundle) -> Bundle:
    """A diagnostic bundle from the older document; checks that its assumptions rest on count as supported if they are resolved."""
    datasets = []
    for i, f in enumerate(old.get("files") or []):
        known = f.get("assumptions") or []
        by = {a.get("key"): a for a in known}
        seen = lambda k: "supported" if by.get(k, {}).get("value") not in (None, "") else "needs_input"
        findings = [{"key": c, "title": c, "status": seen(k), "confidence": unit(by.get(k, {}).get("confidence")), "summary": "", "evidence": {"task_type": by.get(k, {}).get("value")} if c == "problem_type" else {}, "warnings": []} for c, k in (("problem_type", "task_type"), ("target_definition", "target_column"))]
        datasets.append({"dataset_id": f"ds_{i + 1:03d}", "display_name": str(f.get("display_name", "")), "detected_type": str(f.get("detected_type", "unknown")), "detection_confidence": 0.0, "input_fingerprint": fingerprint(str(f.get("display_name", ""))), "coverage": {"supported_vital_checks": sum(x["status"] == "supported" for x in findings), "total_vital_checks": 12}, "dataset_profile": {}, "vital_findings": findings, "assumptions": known, "warnings": []})
    ready = decide.readiness(dataset_rows(spark, datasets))
    by_id = {x.dataset_id: x for x in ready.select("dataset_id", "readiness_state", "blocking_reasons", "required_user_actions", "confidence_score").collect()}
    for d in datasets:
        d |= {k: by_id[d["dataset_id"]][k] for k in ("readiness_state", "blocking_reasons", "required_user_actions", "confidence_score")}
    return envelope("diagnostic_bundle", "diag", "adapter") | {"input": {"path": str(old.get("input_path", "")), "fingerprint": fingerprint(str(old.get("input_path", "")))}, "summary": decide.bundle_summary(ready).first().asDict(), "datasets": datasets}


# How tasks are named in pipeline configurations (kind, loss, outputs if they don't depend on classes).
TASK_FIELDS = {"binary_classification": ("binary", "bce_with_logits", 1), "multiclass_classification": ("multiclass", "cross_entropy", "$infer_class_count"), "multilabel_classification": ("multiclass", "bce_with_logits", "$infer_label_count"), "regression": ("regression", "mse", 1)}


# The configuration fields, names and defaults in intent() and search_space() are those of the bundle format.


def intent(family: str, task: str, classes: int, regime: int) -> Bundle:
    """The pipeline that a candidate asks for; what is open is named."""
    kind, loss, outputs = TASK_FIELDS.get(task, ("regression", "mse", "$infer_target_dim"))
    if isinstance(outputs, str) and classes > 1 and task in TASK_FIELDS:
        outputs = classes
    if family == "mlp":
        model: Bundle = {"spec": {"input_dim": "$infer_from_dataset", "out_dim": outputs, "task_type": kind, "hidden_dims": decide.WIDTHS[regime][0], "activation": "relu", "use_dropout": True, "dropout_p": 0.1, "use_layer_norm": True}}
        fragment: Bundle = {"kind": "mlp", "model": model, "criterion": {"kind": loss}, "data": {"dataset_kind": "custom", "modality": "tabular", "module": "$user_supplied", "class_name": "$user_supplied", "init_args": {}}, "optim": {"kind": "adamw", "lr": 0.001, "weight_decay": decide.DECAYS[regime][0]}, "train": {"max_epochs": 20}}
        return {"pipeline_kind": "mlp", "pipeline_name_template": f"mlp_{kind}", "config_fragment": fragment, "unresolved_fields": ["model.spec.input_dim", "model.spec.out_dim", "data.module", "data.class_name"]}
    if family == "mtl":
        return {"pipeline_kind": "mtl", "pipeline_name_template": "mtl_auto", "config_fragment": {"kind": "mtl", "model": {"spec": {"backbone_kind": "mlp", "tasks": "$user_supplied_task_list"}}, "criterion": {"kind": "weighted_mtl", "task_losses": "$user_supplied_loss_map"}, "data": {"dataset_kind": "custom", "modality": "tabular"}}, "unresolved_fields": ["model.spec.tasks", "criterion.task_losses", "data.module", "data.class_name"]}
    blocks = [{"out_channels": n, "kernel_size": 3, "pool": "max"} for n in (32, 64)]
    return {"pipeline_kind": "cnn", "pipeline_name_template": f"cnn_probe_{kind}", "config_fragment": {"kind": "cnn", "model": {"in_channels": "$infer_or_user_supplied", "task_type": kind, "conv_blocks": blocks}, "criterion": {"kind": loss}, "data": {"dataset_kind": "custom", "modality": "image"}}, "unresolved_fields": ["model.in_channels", "model.num_classes", "data.module", "data.class_name"]}


def search_space(family: str, regime: int) -> Bundle:
    pick = lambda *xs: {"type": "categorical", "choices": list(xs)}
    rate = lambda high: {"type": "float", "low": 1e-4, "high": high, "log": True}
    if family == "mlp":
        return {"model.spec.hidden_dims": pick(*decide.WIDTHS[regime]), "model.spec.dropout_p": {"type": "float", "low": 0.0, "high": 0.4}, "model.spec.use_layer_norm": pick(True, False), "optim.lr": rate(3e-3), "optim.weight_decay": pick(*decide.DECAYS[regime]), "train.max_epochs": pick(12, 20, 32)}
    if family == "mtl":
        return {"model.spec.mlp_backbone.hidden_dims": pick([128, 64], [256, 128]), "optim.lr": rate(2e-3), "criterion.weights_mode": pick("uniform", "learned_uncertainty")}
    return {"model.conv_blocks[0].out_channels": pick(16, 32, 64), "model.conv_blocks[1].out_channels": pick(32, 64, 128), "optim.lr": rate(2e-3)}


def recommendation_bundle(spark: SparkSession, diagnosis: Bundle, most: int = 3) -> Bundle:
    rows = decide.recommendation(decided_rows(spark, diagnosis), most).orderBy("dataset_id").collect()
    datasets = []
    for r in rows:
        regime = 0 if r.n_over_d < decide.RATIOS[0] else 1 if r.n_over_d < decide.RATIOS[1] else 2
        found = [{"candidate_id": c.candidate_id, "rank": c["rank"], "family": c.family, "fit_score": c.fit_score, "confidence": c.confidence, "rationale": c.rationale, "collator_intent": intent(c.family, r.task_type, r.classes, regime), "hpo_space": {"sampler": "tpe", "pruner": "median", "max_trials": c.max_trials, "search_space": search_space(c.family, regime), "objective_metric": r.metric, "validation_strategy": r.validation}, "risks": c.risks} for c in r.candidates]
        datasets.append({"dataset_id": r.dataset_id, "display_name": r.display_name, "decision_state": r.decision_state, "required_user_actions": r.required_user_actions, "recommended_objective_metric": r.metric, "recommended_validation_strategy": r.validation, "confidence_score": r.confidence_score, "blocking_reasons": r.blocking_reasons, "candidates": found})
    count = lambda s: sum(d["decision_state"] == s for d in datasets)
    summary = {"dataset_count": len(datasets), "ready_count": count("ready"), "degraded_count": count("degraded"), "blocked_count": count("blocked"), "recommendation_count": sum(len(d["candidates"]) for d in datasets)}
    return envelope("recommendation_bundle", "rec", "recommend") | {"input_diagnostic_hash": payload_hash(diagnosis), "summary": summary, "datasets": datasets}


def gains(results: Bundle | None) -> list[float]:
    return [float(r.get("confidence_gain") or 0.0) for r in (results or {}).get("results") or []]


def loop_decision_bundle(spark: SparkSession, recommendation: Bundle, results: Bundle | None = None, loop_id: str | None = None, round_index: int = 1, max_rounds: int = 3, max_probes: int = 12, min_gain: float = 0.02) -> Bundle:
    s, got = recommendation["summary"], gains(results)
    mean = sum(got) / len(got) if got else 0.0
    state = spark.createDataFrame([(s["dataset_count"], s["ready_count"], s["degraded_count"], s["blocked_count"], len(got), mean, round_index, max_rounds, max_probes, float(min_gain))], "datasets int, ready int, degraded int, blocked int, results int, mean_gain double, round_index int, max_rounds int, max_results int, min_gain double")
    action = decide.loop_action(state).first().action
    reason = {"finalize": "Nothing is left to probe.", "stop": f"Round {round_index} of {max_rounds}, {len(got)} of {max_probes} probes.", "await_operator": f"The mean gain of {mean:.4f} is below {min_gain:.4f}.", "request_probes": "Datasets remain that are not ready."}[action]
    return envelope("loop_decision_bundle", "loop_dec", "loop") | {"loop_run_id": loop_id or f"loop_{uuid.uuid4().hex[:12]}", "round_index": max(1, round_index), "decision": {"action": action, "reason": reason, "should_emit_probe_requests": action == "request_probes"}, "summary": {**{k: s[k] for k in ("dataset_count", "ready_count", "degraded_count", "blocked_count")}, "probe_results_seen": len(got), "mean_confidence_gain": round(mean, 6)}}


def recommended_rows(spark: SparkSession, recommendation: Bundle) -> DataFrame:
    rows = [(d["dataset_id"], d["decision_state"], d["required_user_actions"], [(c["family"],) for c in d["candidates"]]) for d in recommendation["datasets"]]
    return spark.createDataFrame(rows, "dataset_id string, decision_state string, required_user_actions array<string>, candidates array<struct<family: string>>")


# What each probe runs.
PROBE_MODES: dict[str, Bundle] = {
    "split_sensitivity_probe": {"mode": "cross_validation_probe", "strategies": ["kfold", "stratified_kfold", "group_kfold", "time_series_split"]},
    "unsupervised_structure_probe": {"mode": "unsupervised_probe", "algorithms": ["pca", "kmeans", "isolation_forest"]},
    "missingness_impact_probe": {"mode": "ablation_probe", "imputation_strategies": ["median", "most_frequent", "none_with_indicator"]},
}


def probe_request_bundle(spark: SparkSession, diagnosis: Bundle, recommendation: Bundle, results: Bundle | None = None, loop_id: str | None = None, round_index: int = 1, max_rounds: int = 3, max_probes: int = 12, min_gain: float = 0.02, per_dataset: int = 2) -> Bundle:
    old = spark.createDataFrame([(str(r.get("request_id")),) for r in results["results"]], "request_id string") if results and results.get("results") else None
    planned = decide.planned_probes(recommended_rows(spark, recommendation), old, per_dataset)
    rows, totals = planned.orderBy("dataset_id", "plan_order").collect(), {r.priority: r for r in decide.probe_totals(planned).collect()}
    best = {d["dataset_id"]: d["candidates"][0] for d in recommendation["datasets"] if d["candidates"]}
    requests = []
    for r in rows[:max_probes]:
        hpo: Bundle = {"max_trials": r.max_trials}
        if r.probe_kind == "supervised_baseline_probe":
            space = best[r.dataset_id]["hpo_space"]
            hpo = {"sampler": space["sampler"], "pruner": space["pruner"], "max_trials": min(20, space["max_trials"])}
        what = PROBE_MODES.get(r.probe_kind) or best[r.dataset_id]["collator_intent"]
        requests.append({"request_id": r.request_id, "dataset_id": r.dataset_id, "priority": r.priority, "reason": r.reason, "probe_kind": r.probe_kind, "expected_signals": r.signals, "collator_request": {"candidate_family": r.candidate_family, "intent": what, "hpo": hpo}, "budget": {"max_trials": r.max_trials, "max_runtime_minutes": r.max_runtime_minutes}})
    # totals are those before the global limit
    count = lambda f: sum(f(t) for t in totals.values())
    summary = {"request_count": len(requests), "dataset_count": len({r["dataset_id"] for r in requests}), "priority_counts": {p: totals[p].n if p in totals else 0 for p in ("high", "medium", "low")}, "estimated_budget": {"max_trials_total": count(lambda t: t.trials), "max_runtime_minutes": count(lambda t: t.minutes)}}
    return envelope("probe_request_bundle", "probe_req", "loop") | {"loop_run_id": loop_id or f"loop_{uuid.uuid4().hex[:12]}", "round_index": max(1, round_index), "source_hashes": {"diagnostic_bundle_hash": payload_hash(diagnosis), "recommendation_bundle_hash": payload_hash(recommendation), "prior_probe_result_hash": payload_hash(results) if results else None}, "summary": summary, "stop_conditions": {"max_rounds": max(1, max_rounds), "max_total_probes": max(1, max_probes), "min_confidence_gain": float(min_gain)}, "requests": requests}


def probe_result_bundle(spark: SparkSession, requests: Bundle) -> Bundle:
    """Results of all requests: simulated from their ids, not measured."""
    rows = [(r["request_id"], r["dataset_id"], r["probe_kind"], r["collator_request"].get("candidate_family", "mlp"), list(r.get("expected_signals") or []), int(r["budget"]["max_trials"]), int(r["budget"]["max_runtime_minutes"]), i) for i, r in enumerate(requests.get("requests") or [])]
    df = spark.createDataFrame(rows, "request_id string, dataset_id string, probe_kind string, candidate_family string, signals array<string>, max_trials int, max_runtime_minutes int, at int")
    done = decide.simulated(df)
    got = {r.request_id: r for r in done.collect()}
    results = []
    for r in requests.get("requests") or []:
        x = got[r["request_id"]]
        good = x.status == "success"
        whole = {k: int(v) if k == "max_trials_budget" else v for k, v in x.metrics.items()}
        artifacts = {"collator_run_id": x.run_id, "candidate_family": x.candidate_family.lower(), "summary_uri": f"mock://collator/{x.dataset_id}/{x.request_id}/summary.json"} if good else {"notes": "The family is not supported."}
        results.append({"request_id": x.request_id, "dataset_id": x.dataset_id, "status": x.status, "probe_kind": x.probe_kind, "signals": x.signals if good else [], "metrics": whole, "confidence_gain": x.confidence_gain, "trials_run": x.trials_run, "runtime_minutes": x.runtime_minutes, "artifacts": artifacts, "error": None if good else f"Family '{x.candidate_family}' is not among {list(decide.FAMILIES)}."})
    return envelope("probe_result_bundle", "probe_res", "probes") | {"loop_run_id": str(requests.get("loop_run_id", "")), "round_index": int(requests.get("round_index") or 1), "source_probe_request_hash": payload_hash(requests), "summary": decide.result_summary(done).first().asDict(), "results": results}


# Required keys of each bundle and of its parts, and the values that states may take.
TOP = ("run_id", "generated_at_utc", "producer", "summary")
REQUIRED: dict[str, tuple[tuple[str, ...], str, tuple[str, ...], tuple[str, tuple[str, ...]] | None]] = {
    "diagnostic_bundle": (("input", "datasets"), "datasets", ("dataset_id", "display_name", "detected_type", "coverage", "assumptions", "vital_findings"), ("readiness_state", ("ready", "degraded", "blocked"))),
    "recommendation_bundle": (("input_diagnostic_hash", "datasets"), "datasets", ("dataset_id", "display_name", "decision_state", "required_user_actions", "recommended_objective_metric", "recommended_validation_strategy", "confidence_score", "blocking_reasons", "candidates"), ("decision_state", ("ready", "degraded", "blocked"))),
    "loop_decision_bundle": (("loop_run_id", "round_index", "decision"), "", (), None),
    "probe_request_bundle": (("loop_run_id", "round_index", "source_hashes", "stop_conditions", "requests"), "requests", ("request_id", "dataset_id", "priority", "reason", "probe_kind", "expected_signals", "collator_request", "budget"), ("priority", ("high", "medium", "low"))),
    "probe_result_bundle": (("loop_run_id", "round_index", "source_probe_request_hash", "results"), "results", ("request_id", "dataset_id", "status", "probe_kind", "signals", "metrics", "confidence_gain", "trials_run", "runtime_minutes", "artifacts", "error"), ("status", ("success", "failed"))),
}
ACTIONS = ("finalize", "stop", "await_operator", "request_probes")


def errors(bundle: Any, kind: str) -> list[str]:
    """What is wrong with a bundle of that kind; nothing if it is valid."""
    if not isinstance(bundle, dict):
        return ["the bundle is no object"]
    keys, part, own, state = REQUIRED[kind]
    out = [] if bundle.get("schema_version") == f"{kind}.v1" else [f"schema_version is {bundle.get('schema_version')!r}, not '{kind}.v1'"]
    out += [f"{k} is missing" for k in (*TOP, *keys) if k not in bundle]
    if kind == "loop_decision_bundle":
        action = (bundle.get("decision") or {}).get("action")
        return out + ([] if action in ACTIONS else [f"decision.action is {action!r}"])
    items = bundle.get(part)
    if not isinstance(items, list):
        return [*out, f"{part} is no list"]
    for i, x in enumerate(items):
        if not isinstance(x, dict):
            out.append(f"{part}[{i}] is no object")
            continue
        out += [f"{part}[{i}].{k} is missing" for k in own if k not in x]
        if state and x.get(state[0]) not in state[1]:
            out.append(f"{part}[{i}].{state[0]} is {x.get(state[0])!r}")
    return out


def output_path(path: str, default: str) -> Path:
    """The file to write: a folder, or a name without .json, takes the default name inside."""
    p = Path(path).expanduser()
    return p / default if p.is_dir() or p.suffix.lower() != ".json" else p


def write_json(bundle: Bundle, path: Path) -> Path:
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(json.dumps(bundle, indent=2, ensure_ascii=False, default=str))
    return path
