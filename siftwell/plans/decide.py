"""Decisions over diagnosed datasets, as column expressions: one row a dataset in, one row a dataset out.

A dataset row holds its findings and assumptions as arrays of structs (``DATASET``).
Readiness says how far the diagnosis carries; the recommendation ranks model families; the
loop plans probes; probes are simulated from a hash of their id, reproducibly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import name_id, probe_id, unit_interval

ASSUMPTION = "struct<key: string, value: string, confidence: double, status: string, source: string, evidence: array<string>, risk_if_wrong: string>"
FINDING = "struct<key: string, title: string, status: string, confidence: double, summary: string, evidence: string, warnings: array<string>>"
DATASET = f"dataset_id string, display_name string, detected_type string, detection_confidence double, supported int, total int, assumptions array<{ASSUMPTION}>, vital_findings array<{FINDING}>, warnings array<string>"

# The messages of readiness() and decision(), whose words probe planning reads and whose texts bundles exchange.

# Assumptions that a decision needs, and those that it can do without.
CORE, OPTIONAL = ("task_type", "target_column"), ("split_column", "time_column", "group_column", "objective_metric")
NEEDED_CHECKS, WANTED_CHECKS = ("problem_type", "target_definition"), ("data_splitting_structure", "evaluation_metric")
MIN_COVERAGE = 0.6


def item(array: str, key: str) -> Column:
    """The last element of that key."""
    return F.try_element_at(F.filter(array, lambda x: x["key"] == key), F.lit(-1))


def texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def unset(a: Column) -> Column:
    return (a["status"] == "unresolved") | F.coalesce(a["value"] == "", F.lit(True))


def evidence(key: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(item("vital_findings", key)["evidence"]), path, kind)


def unsupported(key: str) -> Column:
    return F.coalesce(item("vital_findings", key)["status"], F.lit("needs_input")) != "supported"


def readiness(datasets: DataFrame) -> DataFrame:
    """Adds readiness_state, blocking_reasons, required_user_actions and confidence_score."""
    block, wait = [], []
    for k in sorted(CORE):
        a = item("assumptions", k)
        block.append(F.when(a.isNull(), F.lit(f"Missing core assumption: {k}.")).when(unset(a), F.concat(F.lit(f"Core assumption '{k}' is "), a["status"], F.lit("."))))
        wait.append(F.when(a.isNotNull() & ~unset(a) & (a["status"] == "needs_user_verification"), F.lit(f"Core assumption '{k}' needs user verification.")))
    block += [F.when(unsupported(k), F.lit(f"Vital diagnostic '{k}' is not supported.")) for k in NEEDED_CHECKS]
    for k in sorted(OPTIONAL):
        a = item("assumptions", k)
        wait.append(F.when(a.isNull(), F.lit(f"Optional assumption '{k}' missing.")).when(a["status"] != "auto_accept", F.concat(F.lit(f"Optional assumption '{k}' is "), a["status"], F.lit("."))))
    wait += [F.when(unsupported(k), F.lit(f"Vital diagnostic '{k}' needs more input.")) for k in WANTED_CHECKS]
    shown = lambda a: F.coalesce(F.concat(F.lit("'"), a["value"], F.lit("'")), F.lit("None"))
    verify = F.transform(
        F.filter("assumptions", lambda a: a["status"] != "auto_accept"),
        lambda a: F.when(a["status"] == "needs_user_verification", F.concat(F.lit("Verify assumption '"), a["key"], F.lit("' (current value: "), shown(a), F.lit(").")))
        .otherwise(F.concat(F.lit("Provide value for unresolved assumption '"), a["key"], F.lit("'."))),
    )
    out = datasets.withColumn("_block", texts(*block)).withColumn("_wait", texts(*wait))
    state = F.when(F.size("_block") > 0, "blocked").when(F.size("_wait") > 0, "degraded").otherwise("ready")
    reasons = F.when(F.col("readiness_state") == "blocked", F.col("_block")).otherwise(F.col("_wait"))
    out = out.withColumn("readiness_state", state).withColumn("required_user_actions", F.array_distinct(F.concat(verify, reasons)))
    weigh = lambda a: a["confidence"] * F.when(a["status"] == "auto_accept", 1.0).when(a["status"] == "needs_user_verification", 0.6).otherwise(0.0)
    mean = lambda array, f: F.coalesce(F.try_divide(F.aggregate(array, F.lit(0.0), lambda s, a: s + f(a)), F.size(array)), F.lit(0.0))
    score = 0.5 * F.col("supported") / F.greatest("total", F.lit(1)) + 0.3 * mean("assumptions", weigh) + 0.2 * mean("vital_findings", lambda f: f["confidence"])
    out = out.withColumn("confidence_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))
    return out.withColumn("blocking_reasons", F.when(F.col("readiness_state") == "blocked", F.col("_block")).otherwise(F.array().cast("array<string>"))).drop("_block", "_wait")


def bundle_summary(ready: DataFrame) -> DataFrame:
    """One row: counts, the worst state, and the mean confidence of the datasets."""
    rank = F.when(F.col("readiness_state") == "blocked", 2).when(F.col("readiness_state") == "degraded", 1).otherwise(0)
    return ready.agg(
        F.count("*").alias("dataset_count"), F.coalesce(F.sum(F.size(F.filter("assumptions", lambda a: a["status"] != "auto_accept"))), F.lit(0)).alias("assumptions_needing_verification"), F.coalesce(F.sum("supported"), F.lit(0)).alias("supported_vital_checks"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_vital_checks"),
        F.element_at(F.array(F.lit("ready"), F.lit("degraded"), F.lit("blocked")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("readiness_state"), F.coalesce(F.bround(F.avg("confidence_score"), 3), F.lit(0.0)).alias("confidence_score"),
    )


# recommendation -------------------------------------------------------------

# Search spaces by rows per feature (below 5, below 20, others).
RATIOS = (5.0, 20.0)
TRIALS = (40, 60, 80)
WIDTHS = ([[64, 32], [128, 64]], [[128, 64], [256, 128], [256, 128, 64]], [[256, 128], [512, 256], [512, 256, 128]])
DECAYS = ([1e-4, 3e-4, 1e-3], [1e-5, 1e-4, 3e-4], [1e-6, 1e-5, 1e-4])
CANDIDATE = "struct<family: string, fit_score: double, confidence: double, rationale: array<string>, risks: array<string>, max_trials: int>"


def decision(ready: DataFrame) -> DataFrame:
    """Adds decision_state, _reasons and decision_actions to readiness rows."""
    block, slow, acts = [], [], []
    seed = F.when(F.col("readiness_state") == "blocked", F.col("blocking_reasons")).otherwise(F.array().cast("array<string>"))
    for k in CORE:
        a = item("assumptions", k)
        verify = a.isNotNull() & ~unset(a) & (a["status"] == "needs_user_verification")
        block.append(F.when(a.isNull(), F.lit(f"Missing core assumption: {k}.")).when(unset(a), F.concat(F.lit(f"Core assumption '{k}' is "), a["status"], F.lit("."))))
        slow.append(F.when(verify, F.lit(f"Core assumption '{k}' needs user verification.")))
        acts.append(F.when(a.isNull(), F.lit(f"Provide {k}.")).when(unset(a) | verify, F.lit(f"Confirm core assumption '{k}'.")))
    for k in NEEDED_CHECKS:
        bad = item("vital_findings", k).isNotNull() & unsupported(k)
        block.append(F.when(bad, F.lit(f"Vital diagnostic '{k}' is not supported.")))
        acts.append(F.when(bad, F.lit(f"Resolve vital diagnostic '{k}'.")))
    later = []
    for k in OPTIONAL:
        a = item("assumptions", k)
        slow.append(F.when(a.isNull(), F.lit(f"Optional assumption '{k}' is missing.")).when(a["status"] != "auto_accept", F.concat(F.lit(f"Optional assumption '{k}' is "), a["status"], F.lit("."))))
        later.append(F.when(a.isNull(), F.lit(f"Add optional assumption '{k}' if available.")).when(a["status"] != "auto_accept", F.lit(f"Verify optional assumption '{k}'.")))
    thin = (F.col("total") > 0) & (F.col("supported") / F.greatest("total", F.lit(1)) < MIN_COVERAGE)
    slow.append(F.when(thin, F.lit("Vital diagnostic coverage is below 60%.")))
    later.append(F.when(thin, F.lit("Increase diagnostic coverage before broad model search.")))
    out = ready.withColumn("_block", F.array_distinct(F.concat(seed, texts(*block)))).withColumn("_slow", F.array_distinct(texts(*slow)))
    state = F.when(F.size("_block") > 0, "blocked").when(F.size("_slow") > 0, "degraded").otherwise("ready")
    out = out.withColumn("decision_state", state)
    more = F.when(F.col("decision_state") == "blocked", texts(*acts)).otherwise(F.concat(texts(*acts), texts(*later)))
    out = out.withColumn("decision_actions", F.array_distinct(F.concat("required_user_actions", more)))
    return out.withColumn("_reasons", F.when(F.col("decision_state") == "blocked", F.col("_block")).otherwise(F.col("_slow"))).drop("_block", "_slow")


def recommendation(ready: DataFrame, most: int = 3) -> DataFrame:
    """(dataset_id, decision_state, required_user_actions, metric, validation, confidence_score, blocking_reasons, candidates and what they rest on)."""
    out = decision(ready)
    value = lambda k: F.nullif(item("assumptions", k)["value"], F.lit(""))
    task = F.coalesce(value("task_type"), F.nullif(evidence("problem_type", "$.task_type", "string"), F.lit("")), F.lit("unknown"))
    out = out.withColumn("task_type", task)
    fallback = F.when(F.col("task_type").contains("binary"), "roc_auc").when(F.col("task_type").rlike("multiclass|multilabel"), "f1_macro").when(F.col("task_type") == "regression", "mae")
    out = out.withColumn("metric", F.coalesce(value("objective_metric"), evidence("evaluation_metric", "$.recommended_metrics[0]", "string"), evidence("evaluation_metric", "$.metric", "string"), fallback))
    temporal = F.coalesce(evidence("problem_type", "$.temporal", "boolean"), F.lit(False))
    validation = F.when(value("split_column").isNotNull(), "predefined_split_column").when(value("time_column").isNotNull(), "time_series_split").when(value("group_column").isNotNull(), "group_kfold").when(temporal, "time_series_split").when(F.col("task_type").rlike("binary|multiclass|multilabel"), "stratified_kfold").when(F.col("task_type") == "regression", "kfold")
    out = out.withColumn("validation", validation)
    cut = F.when(F.col("decision_state") == "blocked", 0.4).when(F.col("decision_state") == "degraded", 0.75).otherwise(1.0)
    tired = F.when(F.size("decision_actions") > 0, F.greatest(F.lit(0.4), 1.0 - 0.05 * F.size("decision_actions"))).otherwise(1.0)
    out = out.withColumn("decision_confidence", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence_score") * cut * tired)), 3))

    number = lambda key, path: F.coalesce(evidence(key, path, "double"), F.lit(0.0))
    out = out.withColumns({
        "n_over_d": number("sample_size_vs_feature_dimension", "$.n_over_d"), "d_features": number("sample_size_vs_feature_dimension", "$.d_features").cast("int"), "classes": number("label_distribution", "$.classes").cast("int"),
        "_missing": number("missingness", "$.overall_missing_rate"), "_wordy": number("feature_types", "$.feature_type_counts.text") + number("feature_types", "$.feature_type_counts.sequence"),
        "_noise": F.greatest(number("noise_level", "$.max_numeric_outlier_rate"), number("noise_level", "$.label_conflict_proxy")), "_rare": F.coalesce(evidence("label_distribution", "$.rare_event", "boolean"), F.lit(False)) | (number("label_distribution", "$.imbalance_ratio") >= 10), "_collinear": number("correlation_structure", "$.high_corr_pair_count"),
    })
    c = F.col("decision_confidence")
    bounded = lambda x, lo, hi: F.bround(F.greatest(F.lit(lo), F.least(F.lit(hi), x)), 3)
    signs = [  # condition, change of fit, rationale, risk
        (F.col("n_over_d") < RATIOS[0], 0.05, "Few rows a feature: narrow networks, strong regularisation.", None),
        (F.col("_missing") > 0.15, 0.05, None, "Much is missing: impute and mark it."),
        (F.col("_wordy") > 0, 0.10, None, "Text or sequence features need encoders."),
        (F.col("_rare"), 0.0, "Imbalanced classes: weigh them and tune the threshold.", None),
        (F.col("_noise") > 0.2, 0.04, None, "Noise: expect variance between trials."),
        (F.col("_collinear") > 10, 0.0, "Collinear features: prune and regularise.", None),
        ((F.col("d_features") > 0) & (F.col("d_features") <= 10), 0.0, "Few features: prefer simple shapes.", None),
    ]
    fit = reduce(lambda s, x: s - F.when(x[0], x[1]).otherwise(0.0), signs, F.lit(0.66))
    trials = F.when(F.col("n_over_d") < RATIOS[0], TRIALS[0]).when(F.col("n_over_d") < RATIOS[1], TRIALS[1]).otherwise(TRIALS[2])
    one = lambda family, score, sure, why, risk, n: F.struct(F.lit(family).alias("family"), score.alias("fit_score"), sure.alias("confidence"), why.alias("rationale"), risk.alias("risks"), n.cast("int").alias("max_trials"))
    mlp = one("mlp", bounded(fit, 0.1, 0.95), bounded(0.55 + 0.4 * c, 0.0, 1.0), texts(F.lit("A dense network is the default for tables."), *[F.when(s, F.lit(why)) for s, _, why, _ in signs if why]), texts(*[F.when(s, F.lit(risk)) for s, _, _, risk in signs if risk]), trials)
    mtl = one("mtl", F.lit(0.62), bounded(0.45 + 0.35 * c, 0.0, 1.0), F.array(F.lit("Several labels a row can share a representation.")), F.array(F.lit("The heads of the tasks are open.")), F.lit(40))
    cnn = one("cnn", bounded(0.53 + 0.1 * c, 0.1, 0.95), bounded(0.4 + 0.3 * c, 0.0, 1.0), F.array(F.lit("Wide arrays may be flattened images.")), F.array(F.lit("The images' shape is a guess.")), F.lit(30))
    found = F.array_compact(F.array(mlp, F.when(F.col("task_type") == "multilabel_classification", mtl), F.when((F.col("detected_type") == "npz") & (F.col("d_features") >= 512), cnn)))
    # by fit, the order of families deciding among equals
    keyed = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["fit_score"]).alias("k"), i.alias("i"), x.alias("x"))))
    ranked = F.transform(F.slice(keyed, 1, max(1, most)), lambda x, i: F.struct(F.concat("dataset_id", F.lit("_cand_"), F.lpad((i + 1).cast("string"), 2, "0")).alias("candidate_id"), (i + 1).alias("rank"), x["x"]["family"].alias("family"), x["x"]["fit_score"].alias("fit_score"), x["x"]["confidence"].alias("confidence"), x["x"]["rationale"].alias("rationale"), x["x"]["risks"].alias("risks"), x["x"]["max_trials"].alias("max_trials")))
    out = out.withColumn("candidates", F.when(F.col("decision_state") != "blocked", ranked).otherwise(F.slice(ranked, 1, 0)))
    review = F.when(F.col("decision_state") != "blocked", F.transform("_reasons", lambda r: F.concat(F.lit("Review: "), r))).otherwise(F.array().cast("array<string>"))
    actions = F.array_distinct(F.concat("decision_actions", review))
    return out.select("dataset_id", "display_name", "decision_state", actions.alias("required_user_actions"), "metric", "validation", F.col("decision_confidence").alias("confidence_score"), F.when(F.col("decision_state") == "blocked", F.col("_reasons")).otherwise(F.array().cast("array<string>")).alias("blocking_reasons"), "candidates", "task_type", "classes", "n_over_d")


# loop -----------------------------------------------------------------------


def loop_action(state: DataFrame) -> DataFrame:
    """(…, action): from dataset, ready, degraded and blocked counts, results, mean_gain, round_index, max_rounds, max_results, min_gain."""
    open_ = (F.col("blocked") > 0) | (F.col("degraded") > 0)
    action = (
        F.when((F.col("datasets") > 0) & (F.col("ready") == F.col("datasets")) & ~open_, "finalize").when(F.col("round_index") > F.col("max_rounds"), "stop").when(F.col("results") >= F.col("max_results"), "stop")
        .when((F.col("results") > 0) & (F.col("blocked") == 0) & (F.col("degraded") > 0) & (F.col("mean_gain") < F.col("min_gain")), "await_operator").when(open_, "request_probes").otherwise("finalize")
    )
    return state.withColumn("action", action)


# Probes in planning order: kind, priority, reason, signals, trials, minutes.
PROBES = (
    ("supervised_baseline_probe", "high", "Need baseline performance to calibrate recommendation confidence.", ("baseline_metric", "overfit_gap", "training_stability"), 20, 30),
    ("split_sensitivity_probe", "medium", "Split/time/group uncertainty detected; run split sensitivity diagnostics.", ("metric_variance_across_split_strategies", "leakage_suspect_signal"), 8, 25),
    ("unsupervised_structure_probe", "high", "Target uncertainty remains; run unsupervised structure probe for separability/anomaly signals.", ("cluster_separation_score", "reconstruction_error_profile", "outlier_fraction"), 6, 20),
    ("missingness_impact_probe", "low", "Missingness-related uncertainty detected; evaluate imputation robustness.", ("imputation_strategy_delta", "missing_indicator_gain"), 6, 20),
)


def planned_probes(recommended: DataFrame, results: DataFrame | None = None, per_dataset: int = 2) -> DataFrame:
    """(dataset_id, plan_order, request_id, probe_kind, priority, reason, candidate_family, signals, max_trials, max_runtime_minutes) of datasets that aren't ready.

    Probes whose id has a result already (results: request_id) are left out.
    """
    says = lambda words: F.exists("required_user_actions", lambda a: F.lower(a).rlike(words))
    family = F.try_element_at("candidates", F.lit(1))["family"]
    wanted = (family.isNotNull(), says("split|time|group"), says("target") | family.isNull(), says("missing"))
    specs = [F.when(w, F.struct(F.lit(kind).alias("probe_kind"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"), F.array(*map(F.lit, signals)).alias("signals"), F.lit(trials).alias("max_trials"), F.lit(minutes).alias("max_runtime_minutes"))) for w, (kind, priority, reason, signals, trials, minutes) in zip(wanted, PROBES, strict=True)]
    # Spark would push a filter by state, or the one that it infers for a plain explode, below the projections and repeat in it all that they work out
    planned = F.when(F.col("decision_state") != "ready", F.slice(F.array_compact(F.array(*specs)), 1, max(1, per_dataset)))
    rows = recommended.withColumn("_f", F.coalesce(family, F.lit("mlp"))).select("dataset_id", "_f", F.posexplode_outer(planned).alias("plan_order", "p")).where("plan_order IS NOT NULL")
    out = rows.select("dataset_id", "plan_order", probe_id(F.col("dataset_id"), F.col("p.probe_kind"), F.col("p.reason")).alias("request_id"), "p.probe_kind", "p.priority", "p.reason", F.when(F.col("p.probe_kind") == "unsupervised_structure_probe", F.lit("mlp")).otherwise(F.col("_f")).alias("candidate_family"), "p.signals", "p.max_trials", "p.max_runtime_minutes")
    return out.join(results.select("request_id").distinct(), "request_id", "left_anti").select(*out.columns) if results is not None else out


def probe_totals(requests: DataFrame) -> DataFrame:
    """(priority, n, trials, minutes)"""
    return requests.groupBy("priority").agg(F.count("*").alias("n"), F.sum("max_trials").alias("trials"), F.sum("max_runtime_minutes").alias("minutes"))


# Simulated metrics of each probe as (name, offset, slope, falls with the seed), and the gain as (offset, slope, metric that drives it).
FAMILIES = ("cnn", "mlp", "mtl")
METRICS = {
    "supervised_baseline_probe": (("val_metric", 0.58, 0.22, False),),
    "split_sensitivity_probe": (("metric_variance_across_splits", 0.01, 0.08, True), ("leakage_suspect_score", 0.02, 0.25, True)),
    "unsupervised_structure_probe": (("silhouette_score", -0.02, 0.42, False), ("outlier_fraction", 0.01, 0.19, True), ("reconstruction_error", 0.08, 0.45, True)),
    "missingness_impact_probe": (("imputation_strategy_delta", -0.03, 0.12, False), ("missing_indicator_gain", -0.02, 0.09, False)),
    "feature_redundancy_probe": (("kept_feature_ratio", 0.5, 0.4, False), ("metric_delta_after_pruning", -0.05, 0.08, False)),
    "uncertainty_resolution_probe": (("probe_strength", 0.4, 0.5, False), ("consistency_score", 0.5, 0.4, False)),
}
GAINS = {"supervised_baseline_probe": (0.02, 0.04, None), "split_sensitivity_probe": (0.018, 0.03, "-metric_variance_across_splits"), "unsupervised_structure_probe": (0.015, 0.035, "silhouette_score"), "missingness_impact_probe": (0.01, 0.03, "imputation_strategy_delta"), "feature_redundancy_probe": (0.008, 0.03, "metric_delta_after_pruning"), "uncertainty_resolution_probe": (0.01, 0.03, None)}


def simulated(requests: DataFrame) -> DataFrame:
    """(request_id, dataset_id, probe_kind, status, seed, metrics, confidence_gain, trials_run, runtime_minutes, run_id) of planned probes.

    Simulated, not measured: everything follows from the seed, a hash of the request id.
    """
    s, kind = F.col("seed"), F.col("_kind")
    rows = requests.withColumn("seed", unit_interval(F.col("request_id"))).withColumn("_kind", F.when(F.col("probe_kind").isin(*METRICS), F.col("probe_kind")).otherwise("uncertainty_resolution_probe"))
    value = lambda m: m[1] + m[2] * ((1.0 - s) if m[3] else s)
    metrics, gain = None, None
    for name, parts in METRICS.items():
        pairs = [(m[0], value(m)) for m in parts]
        if name == "supervised_baseline_probe":
            val = pairs[0][1]
            train = F.least(F.lit(0.98), val + 0.04 + 0.06 * s)
            pairs += [("train_metric", train), ("overfit_gap", F.greatest(F.lit(0.0), train - val)), ("max_trials_budget", F.col("max_trials").cast("double"))]
        made = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.bround(v, 6))])
        base, slope, by = GAINS[name]
        drive = s if by is None else 1.0 - dict(pairs)[by[1:]] if by.startswith("-") else F.abs(dict(pairs)[by])
        metrics = F.when(kind == name, made) if metrics is None else metrics.when(kind == name, made)
        gain = F.when(kind == name, base + slope * drive) if gain is None else gain.when(kind == name, base + slope * drive)
    good = F.lower("candidate_family").isin(*FAMILIES)
    trials = F.greatest(F.lit(1), F.bround(F.greatest(F.col("max_trials"), F.lit(1)) * (0.7 + 0.25 * s), 0).cast("int"))
    rows = rows.withColumn("trials_run", F.when(good, trials).otherwise(0))
    minutes = F.bround(F.least(F.greatest("max_runtime_minutes", F.lit(1)).cast("double"), F.col("trials_run") * (0.35 + 0.15 * s)), 3)
    return rows.select(
        "request_id", "dataset_id", "probe_kind", F.when(good, "success").otherwise("failed").alias("status"), "seed", F.when(good, metrics).otherwise(F.create_map().cast("map<string,double>")).alias("metrics"), F.when(good, F.bround(gain, 6)).otherwise(0.0).alias("confidence_gain"),
        "trials_run", F.when(good, minutes).otherwise(0.0).alias("runtime_minutes"), F.when(good, F.concat(F.lit("collator_run_"), F.substring(name_id(F.col("request_id")), 1, 12))).alias("run_id"), F.slice("signals", 1, 8).alias("signals"), F.col("candidate_family"),
    )


def result_summary(results: DataFrame) -> DataFrame:
    """One row: counts by status, mean gain (0 without results), trials."""
    return results.agg(F.count("*").alias("result_count"), F.count_if(F.col("status") == "success").alias("success_count"), F.count_if(F.col("status") == "failed").alias("failed_count"), F.coalesce(F.bround(F.avg("confidence_gain"), 6), F.lit(0.0)).alias("mean_confidence_gain"), F.coalesce(F.sum("trials_run"), F.lit(0)).alias("total_trials_run"))


def candidate_rank(candidates: DataFrame, most: int = 3) -> DataFrame:
    """(dataset_id, family, fit_score, rank, candidate_id): the best candidates of each dataset; equal fits keep their order."""
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("fit_score"), "gen_order"))
    out = candidates.withColumn("rank", rank).where(F.col("rank") <= most)
    return out.select("dataset_id", "family", "fit_score", "rank", F.concat("dataset_id", F.lit("_cand_"), F.lpad(F.col("rank").cast("string"), 2, "0")).alias("candidate_id"))
