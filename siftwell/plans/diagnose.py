"""Twelve readiness checks of a table, and the assumptions that follow from them.

Rows are read by aggregates that Spark plans; what comes to the driver has the size of the
schema.  A column's facts come first; they decide roles and task, which decide the rest.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.context import Options
from siftwell.functions import correlation, is_numeric, missing, number, present, skewness, text_of
from siftwell.operators import profile, relations, roles
from siftwell.operators.quantiles import held_at_once, quantiles
from siftwell.operators.roles import Roles, Task
from siftwell.plans.scan import Asked

# The checks with their titles, in report order.
CHECKS = {
    "problem_type": "Problem Type", "target_definition": "Target Definition", "data_splitting_structure": "Data Splitting Structure", "sample_size_vs_feature_dimension": "Sample Size vs Feature Dimension",
    "feature_types": "Feature Types", "missingness": "Missingness", "label_distribution": "Label Distribution", "noise_level": "Noise Level", "feature_scale": "Feature Scale",
    "correlation_structure": "Correlation Structure", "distribution_shift_risk": "Distribution Shift Risk", "evaluation_metric": "Evaluation Metric",
}
FINDING = "key string, title string, status string, confidence double, summary string, evidence string, warnings array<string>"


@dataclass
class Finding:
    key: str
    status: str = "needs_input"
    confidence: float = 0.0
    summary: str = ""
    evidence: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return {"key": self.key, "title": CHECKS[self.key], "status": self.status, "confidence": round(self.confidence, 3), "summary": self.summary, "evidence": self.evidence, "warnings": self.warnings}


#: Shares at which the checks need numeric columns' quantiles, and the columns that each check looks at most.
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
OUTLIER_COLUMNS, SCALE_COLUMNS, TWIN_COLUMNS, SHIFT_COLUMNS = 50, 80, 120, 60
#: Splits that are looked at as a whole list; more are asked for by rank.
FEW_SPLITS = 1000


class Table:
    """A table under diagnosis: what its checks ask of the rows, answered by two wide aggregates and one of quantiles.

    The first aggregate depends on the schema alone; its facts give roles and task.  The second
    takes what depends on those.  Grouped questions (repeated rows, conflicts, classes, splits,
    groups) are one job each, run once, and only for the checks that apply.
    """

    def __init__(self, df: DataFrame, options: Options) -> None:
        self.df, self.options = df.select(*[F.col(f"`{c}`") for c in df.columns[: options.max_columns]]), options
        self.spark, self.columns, self.kinds = df.sparkSession, self.df.columns, profile.kinds(self.df)
        self.facts, self.first, self.n = {}, {}, 0
        if self.columns:
            self.first = self._first()
            self.facts = self._facts()
            self.n = self.first["facts", self.columns[0]]["n_rows"]
        self.roles = Roles.of(self.columns, options)
        if self.roles.target is None:
            barred = {self.roles.time, self.roles.split, self.roles.group, *self.roles.ids}
            scores = {c: r.score for c, r in self.facts.items() if r.score is not None and c not in barred}
            self.roles = Roles(roles.best_target(scores, self.columns), self.roles.time, self.roles.split, self.roles.group, self.roles.ids)
        self.task = self._task()
        self.features = [c for c in self.columns if c != self.roles.target]
        self.inputs = [c for c in self.features if c not in self.roles.ids]
        self.numbers = [c for c in self.features if is_numeric(self.kinds[c])]
        self.quantiles = self._quantiles() if self.n else {}
        self.second = self._second() if self.n else {}
        self.held: dict[str, Any] = {}

    def value(self, c: str) -> Any:
        return number(c, self.kinds[c])

    def _first(self) -> dict[Any, Any]:
        k = self.kinds
        # texts and the row's hash stand in columns of their own, so that they are worked out once a row
        texts = {c: f"_text{i}" for i, c in enumerate(self.columns)}
        plain = [F.col(f"`{c}`") if k[c].typeName() not in ("map", "variant") else text_of(c, k[c]) for c in self.columns]
        asked = Asked(self.df.select("*", *[text_of(c, k[c]).alias(t) for c, t in texts.items()], F.xxhash64(*plain).alias("_row")))
        for c, fields in profile.fact_columns(self.df, self.columns, {c: F.col(t) for c, t in texts.items()}).items():
            asked.add({("facts", c): F.struct(*[v.alias(f) for f, v in fields.items()]), ("missing", c): F.count_if(missing(c, k[c]))})
        for c in (c for c in self.columns if is_numeric(k[c])):
            x = self.value(c)
            asked.add({("scale", c): F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"), skewness(x).alias("skew"))})
        # sums, not a parity: equal rows must not cancel out; of parts of a hash, so that they fit whole numbers
        for c in self.columns[: TWIN_COLUMNS + 1]:
            h = F.xxhash64("_row", texts[c])
            asked.add({("hash", c): F.struct(*[F.sum(F.shiftrightunsigned(h, 22 * k).bitwiseAND(F.lit((1 << 22) - 1))).alias(f"h{k}") for k in range(3)])})
        return asked.answers()

    def _facts(self) -> dict[str, Any]:
        counts = {r["column"]: r.n_distinct for r in profile.distinct_counts(self.df, self.columns).collect()}
        rows = [{"column": c, "n_distinct": counts.get(c, 0)} | self.first["facts", c].asDict() for c in self.columns]
        told = self.spark.createDataFrame(rows, "column string, n_distinct long, kind string, n_rows long, n_present long, bool_like boolean, whole boolean, date_rate double, label_like double, mean_length double")
        task = roles.task_of()
        return {r["column"]: r for r in told.select("*", roles.feature_type_of(self.options.compat).alias("feature_type"), task["col1"].alias("task_type"), task["col2"].alias("confidence"), roles.score_of().alias("score")).collect()}

    def _quantiles(self) -> dict[str, list[float | None]]:
        some = {c: self.value(c) for c in self.numbers[: max(OUTLIER_COLUMNS, SCALE_COLUMNS)]}
        y = self.roles.target
        if y and not self.task.classes:
            some[y] = self.value(y)
        if not held_at_once(self.n, len(some), self.options.exact_quantile_rows):
            return quantiles(self.df, some, list(SHARES), self.options.exact_quantile_rows)
        asked = Asked(self.df)
        asked.add({c: F.percentile(x, F.array(*[F.lit(p) for p in SHARES])) for c, x in some.items()})
        return {c: q or [None] * len(SHARES) for c, q in asked.answers().items()}

    def quantile(self, c: str, share: float) -> float | None:
        return self.quantiles[c][SHARES.index(share)]

    def missing_rate(self, c: str) -> float:
        return self.first["missing", c] / self.n

    @property
    def twins(self) -> list[tuple[str, str]]:
        """Pairs of features whose sums of hashes agree."""
        groups: dict[Any, list[str]] = {}
        for c in self.features[:TWIN_COLUMNS]:
            groups.setdefault(self.first["hash", c], []).append(c)
        return [p for g in groups.values() for p in itertools.combinations(g, 2)]

    def _second(self) -> dict[Any, Any]:
        asked, k, y = Asked(self.df), self.kinds, self.roles.target
        for c in self.numbers[:OUTLIER_COLUMNS]:
            q1, q3 = self.quantile(c, 0.25), self.quantile(c, 0.75)
            if q1 is not None and q3 > q1:
                x, lo, hi = self.value(c), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
                asked.add({("outliers", c): F.avg(((x < lo) | (x > hi)).cast("int"))})
        gone = [c for c in self.columns if 0 < self.first["missing", c] < self.n]
        flags = {c: missing(c, k[c]).cast("double") for c in gone}
        asked.add({("gone", a, b): correlation(flags[a], flags[b]) for a, b in itertools.combinations(sorted(gone), 2)})
        if y and self.task.regression and is_numeric(k[y]):
            v = self.value(y)
            asked.add({("effect", c): F.try_divide(F.abs(F.avg(F.when(missing(c, k[c]), v)) - F.avg(F.when(~missing(c, k[c]), v))), F.stddev_pop(v)) for c in self.features if self.first["missing", c]})
        if len(self.numbers) <= relations.FEW_COLUMNS:
            # without holes the columns' own deviations serve all their pairs
            holes = {c for c in self.numbers if self.first["scale", c].n < self.n}
            for a, b in itertools.combinations(self.numbers, 2):
                both = F.covar_pop(self.value(a), self.value(b))
                spread = self.first["scale", a].std * self.first["scale", b].std
                asked.add({("corr", a, b): correlation(self.value(a), self.value(b)) if {a, b} & holes else F.try_divide(both, F.lit(spread))})
        asked.add({("twins", a, b): F.count_if(text_of(a, k[a]) != text_of(b, k[b])) for a, b in self.twins})
        if self.roles.time:
            asked.add({"times": F.count(relations.time_of(self.roles.time, k))})
        return asked.answers()

    def _task(self) -> Task:
        temporal = bool(self.roles.time)
        if self.options.task_hint and self.options.task_hint.strip():
            return roles.hinted_task(self.roles, self.options.task_hint)
        if self.roles.target is None:
            return Task("unknown", 0.0, "none", temporal)
        fact = self.facts[self.roles.target]
        source = "empty_target" if not fact.n_present else "heuristic" if fact.task_type == "multilabel_classification" else "target_distribution"
        return Task(fact.task_type, fact.confidence, source, temporal)

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        """What several checks need, made once."""
        if name not in self.held:
            self.held[name] = make()
        return self.held[name]

    def is_key(self, c: str) -> bool:
        """Whether every row has a value of its own in a column, as its exact count of distinct values tells. Reals are left out, whose zeros have two texts."""
        kind = self.kinds[c]
        exact = isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType)) or kind == T.StringType()
        return exact and self.facts[c].n_distinct == self.n

    def duplicate_rate(self) -> float:
        """The share of rows that equal others; with a key there are none."""
        return 0.0 if any(self.is_key(c) for c in self.columns) else relations.duplicate_rows(self.df).first().duplicate_rate

    def conflict(self) -> dict[str, Any] | None:
        """Conflicts of equal inputs; with a key among those that are compared no inputs are equal."""
        if not self.roles.target or not self.inputs:
            return None
        if any(self.is_key(c) for c in self.inputs[: relations.SIGNED_COLUMNS]):
            return {"repeated": 0, "conflicting": 0, "conflict_rate": 0.0}
        return self.once("conflict", lambda: relations.conflict_rate(self.df, self.roles.target, self.inputs).first().asDict())

    def drift(self) -> dict[str, Any] | None:
        """The drift between earlier and later rows."""
        return self.once("drift", lambda: measured_drift(self))

    def labels(self) -> tuple[Any, DataFrame]:
        """Facts of the target's classes in one row, and the classes (label, n, n_present): classes, sizes with and without missing targets, and how far label shares differ where each column is missing."""
        return self.once("labels", lambda: measured_labels(self))

    def splits(self) -> tuple[list[str], list[str]]:
        """The first ten splits by name, and the ten largest."""
        return self.once("splits", lambda: measured_splits(self))

    def done(self) -> None:
        if "labels" in self.held:
            self.held["labels"][1].unpersist()


def measured_drift(t: Table) -> dict[str, Any] | None:
    rows = relations.time_drift(t.df, t.roles.time, n=t.second["times"], limit=t.options.exact_quantile_rows).collect() if t.n >= 20 else None
    if rows is None:
        return None
    if not rows:
        return {"shifted_feature_count": 0, "max_standardized_shift": 0.0}
    scores = {r["column"]: round(r["shift"], 6) for r in rows}
    return {"shifted_feature_count": sum(r["shift"] > 0.5 for r in rows), "max_standardized_shift": max(scores.values()), "shift_scores": scores}


def measured_labels(t: Table) -> tuple[Any, DataFrame]:
    y, k = t.roles.target, t.kinds
    gone = [c for c in t.features if 0 < t.first["missing", c] < t.n]
    groups = t.df.groupBy(text_of(y, k[y]).alias("label")).agg(F.count("*").alias("n"), F.count(present(y, k[y])).alias("n_present"), *[F.count_if(missing(c, k[c])).alias(f"_{i}") for i, c in enumerate(gone)]).persist()
    n = F.when(F.col("n_present") > 0, F.col("n_present"))
    apart = [0.5 * F.sum(F.abs(F.col(f"_{i}") / t.first["missing", c] - (F.col("n") - F.col(f"_{i}")) / (t.n - t.first["missing", c]))) for i, c in enumerate(gone)]
    row = groups.agg(F.count(n).alias("classes"), F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.when(F.count("*") >= 2, F.min("n") / F.sum("n")).alias("imbalance"), F.greatest(F.lit(0.0), *apart, F.lit(0.0)).alias("apart")).first()
    return row, groups


def measured_splits(t: Table) -> tuple[list[str], list[str]]:
    counts = profile.class_counts(t.df, t.roles.split)
    found = [(r.label, r.n) for r in counts.limit(FEW_SPLITS + 1).collect()]
    if len(found) > FEW_SPLITS:
        return sorted(r.label for r in counts.orderBy("label").limit(10).collect()), [r.label for r in counts.orderBy(F.desc("n"), "label").limit(10).collect()]
    # by code point, as Spark sorts
    by_name = sorted(found, key=lambda r: r[0].encode())
    return [x for x, _ in by_name[:10]], [x for x, _ in sorted(by_name, key=lambda r: -r[1])[:10]]


def problem_type(t: Table) -> Finding:
    f = Finding("problem_type")
    if t.task.kind == "unknown":
        f.summary, f.evidence, f.warnings = "No task can be told without a target.", {"target_column": t.roles.target}, ["Give a target column or a task hint."]
        return f
    f.status, f.confidence = "supported", t.task.confidence
    f.summary = f"{t.task.kind}, {'several targets' if t.task.multi else 'one target'}, {'temporal' if t.task.temporal else 'static'}."
    f.evidence = {"task_type": t.task.kind, "target_column": t.roles.target, "temporal": t.task.temporal, "inference_source": t.task.source}
    return f


def target_definition(t: Table) -> Finding:
    f = Finding("target_definition")
    if not t.roles.target:
        f.summary, f.warnings = "There is no target.", ["Give a target column to check conflicts and leaks."]
        return f
    found = t.conflict()
    rate = found["conflict_rate"] if found else None
    leaks = roles.leak_suspects(t.roles.target, t.inputs)
    steady = rate is not None and rate < 0.05
    f.status, f.confidence = "supported", 0.7 if t.n >= 200 else 0.55
    f.summary = f"Target '{t.roles.target}': {len(leaks)} suspect columns, deterministic so far: {steady}."
    f.evidence = {"target_column": t.roles.target, "deterministic_proxy": steady, "aggregated_target_name_hint": any(w in roles.plain_name(t.roles.target) for w in roles.AGGREGATE_WORDS), "repeated_signatures": found["repeated"] if found else 0, "conflicting_signatures": found["conflicting"] if found else 0, "collision_noise_rate": rate, "possible_leakage_columns": leaks[:10]}
    f.warnings = ["Names of some features suggest that they leak the target."] * bool(leaks) + ["Equal features have different targets."] * (rate is not None and rate > 0.2)
    return f


def data_splitting_structure(t: Table) -> Finding:
    r = t.roles
    duplicates = t.duplicate_rate()
    values = sorted(t.splits()[0]) if r.split else []
    leak = relations.group_leakage(t.df, r.split, r.group).first().leakage_fraction if r.split and r.group else None
    structure = "explicit_split_column" if r.split else "temporal_order_detected" if r.time else "iid_assumed"
    f = Finding("data_splitting_structure", "supported", 0.8 if r.split else 0.7 if r.time else 0.55, f"{structure}; {duplicates:.3f} of the rows repeat others.")
    f.evidence = {"structure": structure, "split_column": r.split, "group_column": r.group, "time_column": r.time, "split_values_sample": values, "duplicate_row_rate": round(duplicates, 4), "group_leakage_fraction": leak, "time_drift_signal": t.drift() if r.time else None}
    f.warnings = ["Many rows repeat others."] * (duplicates > 0.05) + ["Groups occur in more than one split."] * bool(leak)
    return f


def sample_size(t: Table) -> Finding:
    row = t.spark.createDataFrame([(t.n,)], "n long").select(*profile.size_columns(F.col("n"), len(t.features))).first()
    f = Finding("sample_size_vs_feature_dimension", "supported", 0.9, f"{row.n_rows} rows, {row.d_features} features, {row.n_over_d:.2f} rows a feature.")
    f.evidence = {"n_rows_sampled": row.n_rows, "d_features": row.d_features, "n_over_d": round(row.n_over_d, 4), "regime": row.regime, "regularization": row.regularization}
    return f


def feature_types(t: Table) -> Finding:
    kinds = {c: t.facts[c].feature_type for c in t.features}
    counts: dict[str, int] = {}
    for k in kinds.values():
        counts[k] = counts.get(k, 0) + 1
    return Finding("feature_types", "supported", 0.85, f"Types of {len(kinds)} features.", {"feature_type_counts": counts, "feature_types_by_column": kinds})


def missingness(t: Table) -> Finding:
    rates = {c: t.missing_rate(c) for c in t.columns}
    gone = sorted(c for c, r in rates.items() if r > 0)
    if not gone:
        return Finding("missingness", "supported", 0.9, "Nothing is missing.", {"overall_missing_rate": 0.0, "missing_columns": []})
    overall = sum(t.first["missing", c] for c in t.columns) / max(1, t.n * len(t.columns))
    together = max((abs(v) for k, v in t.second.items() if k[0] == "gone" and v is not None), default=None)
    told = None
    if t.roles.target and t.facts[t.roles.target].n_present:
        if t.task.regression and is_numeric(t.kinds[t.roles.target]):
            told = max((v for k, v in t.second.items() if k[0] == "effect" and v is not None), default=0.0)
        else:
            told = t.labels()[0].apart
    kind = "possibly_informative_missingness" if told is not None and told > 0.1 else "structured_missingness_likely" if together is not None and together > 0.2 else "mostly_mcar_like"
    f = Finding("missingness", "supported", 0.8 if t.n >= 100 else 0.65, f"{overall:.3f} of all cells are missing: {kind}.")
    f.evidence = {"overall_missing_rate": round(overall, 6), "missing_columns": gone, "missing_rate_by_column": {c: round(r, 6) for c, r in sorted(rates.items(), key=lambda x: -x[1])}, "max_missing_indicator_corr": together, "target_missingness_signal": told, "missingness_kind": kind}
    return f


def label_distribution(t: Table) -> Finding:
    f, y = Finding("label_distribution"), t.roles.target
    if not y or not t.facts[y].n_present:
        f.summary = "There is no target." if not y else "The target is empty."
        return f
    if t.task.classes:
        row, groups = t.labels()
        counts = {r.label: r.n_present for r in groups.where("n_present > 0").orderBy(F.desc("n_present"), "label").limit(1000).collect()}
        f.status, f.confidence, f.summary = "supported", 0.85, f"{row.classes} classes."
        f.evidence = {"classes": row.classes, "counts": counts, "minority_rate": round(row.least / row.total, 6), "imbalance_ratio": round(row.most / row.least, 6), "rare_event": row.least / row.total < 0.05, "long_tail": row.classes >= 10 and row.most / row.total < 0.5}
        return f
    if is_numeric(t.kinds[y]):
        own = t.first["scale", y]
        row = {"count": own.n, "mean": own.mean, "std": own.std, **{f"q{round(100 * p):02d}": t.quantile(y, p) for p in (0.01, 0.5, 0.99)}, "skew": own.skew}
    else:
        row = profile.value_distribution(t.df, y, t.options.exact_quantile_rows).first().asDict()
    if not row["count"]:
        f.summary = "The target is neither numbers nor classes."
        return f
    f.status, f.confidence, f.summary, f.evidence = "supported", 0.8, "Distribution of the target's values.", row
    return f


def noise_level(t: Table) -> Finding:
    rates = {c: t.second.get(("outliers", c), 0.0) for c in t.numbers[:OUTLIER_COLUMNS] if t.first["scale", c].n >= 8}
    found = t.conflict()
    if not rates and found is None:
        return Finding("noise_level", summary="Neither numbers nor a target tell of noise.", warnings=["Noise needs repeated measurements or richer labels."])
    f = Finding("noise_level", "supported", 0.5, "Outliers and conflicting labels as signs of noise.", warnings=["These are signs, not an audit of labels."])
    f.evidence = {"max_numeric_outlier_rate": max(rates.values(), default=None), "outlier_rate_by_feature": {c: round(r, 6) for c, r in rates.items()}, "label_conflict_proxy": found["conflict_rate"] if found else None}
    return f


def feature_scale(t: Table) -> Finding:
    if not t.numbers:
        return Finding("feature_scale", summary="There are no numeric features.")
    rows = [t.first["scale", c].asDict() | {"column": c, "q05": t.quantile(c, 0.05), "q95": t.quantile(c, 0.95)} for c in t.numbers[:SCALE_COLUMNS] if t.first["scale", c].n]
    spread, ranges = [r["std"] for r in rows if r["std"] > 0], [r["max"] - r["min"] for r in rows if r["max"] > r["min"]]
    ratio = lambda xs: max(xs) / min(xs) if len(xs) > 1 else None
    heavy = [r["column"] for r in rows if abs(r["skew"]) > 2]
    log = [r["column"] for r in rows if r["q05"] > 0 and r["q95"] / max(r["q05"], 1e-9) > 100 and r["skew"] > 1]

    f = Finding("feature_scale", "supported", 0.8, f"Scales of {len(t.numbers)} numeric features.")
    f.evidence = {"numeric_feature_count": len(t.numbers), "std_scale_ratio": ratio(spread), "range_scale_ratio": ratio(ranges), "orders_of_magnitude_span": math.log10(ratio(ranges)) if ratio(ranges) else None}
    f.evidence |= {"heavy_tail_features": heavy[:20], "log_transform_candidates": log[:20], "feature_stats": {r["column"]: {k: r[k] for k in ("min", "max", "std", "q05", "q95", "skew")} for r in rows}}
    return f


def correlation_structure(t: Table) -> Finding:
    if len(t.features) < 2:
        return Finding("correlation_structure", summary="Correlation needs two features.")
    if len(t.numbers) <= relations.FEW_COLUMNS:
        pairs = [(a, b, t.second["corr", a, b]) for a, b in itertools.combinations(t.numbers, 2)]
    else:
        pairs = [(r.a, r.b, r["corr"]) for r in relations.corr_pairs(t.df, t.numbers).where("abs(corr) >= 0.9").collect()] if len(t.numbers) > 1 else []
    strong = sorted((p for p in pairs if p[2] is not None and abs(p[2]) >= 0.9), key=lambda p: (-abs(p[2]), p[0].encode(), p[1].encode()))
    high = [{"a": a, "b": b, "corr": round(c, 4)} for a, b, c in strong]
    first: dict[str, str] = {}
    for a, b in t.twins:
        if not t.second["twins", a, b] and a not in first:
            first.setdefault(b, a)
    twins = [[first[b], b] for b in t.features if b in first]
    f = Finding("correlation_structure", "supported", 0.78, f"{len(high)} strongly correlated pairs, {len(twins)} equal columns.", {"high_corr_pair_count": len(high), "high_corr_pairs": high[:50], "duplicate_feature_pairs": twins[:30]})
    f.warnings = ["Some numeric features say nearly the same."] * bool(high) + ["Some columns are equal."] * bool(twins) + ["Interactions are not examined here."]
    return f


def shifts(t: Table, base: str, others: list[str]) -> list[tuple[str, str, float]]:
    """(other split, column, shift) of the columns that shift by more than half a standard deviation; a row a split comes to the driver."""
    split = t.roles.split
    some = t.df.where(text_of(split, t.kinds[split]).isin(base, *others))
    names = [c for c in profile.numeric_columns(t.df) if c != split][:SHIFT_COLUMNS]
    return [(r.other, r["column"], r["shift"]) for r in relations.split_shift_of(relations.split_moments(some, split, names).collect(), base, others) if r["shift"] > 0.5] if names else []


def distribution_shift_risk(t: Table) -> Finding:
    r = t.roles
    if r.split:
        sizes = t.splits()[1]
        evidence: dict[str, Any] = {"split_column": r.split, "comparable": False}
        if len(sizes) > 1:
            rows = shifts(t, sizes[0], sizes[1:4])
            by: dict[str, dict[str, float]] = {s: {} for s in sizes[1:4]}
            for other, column, shift in rows:
                by[other][column] = round(shift, 6)
            evidence = {"split_column": r.split, "base_split": sizes[0], "split_values": sizes, "shifted_feature_count": len(rows), "shifted_features_by_split": by}
        return Finding("distribution_shift_risk", "supported", 0.82, f"Splits of '{r.split}' compared.", evidence)
    if r.time:
        return Finding("distribution_shift_risk", "supported", 0.7, f"Earlier and later rows by '{r.time}' compared.", {"time_column": r.time, "temporal_drift_proxy": t.drift()})
    return Finding("distribution_shift_risk", summary="Neither a split nor a time column is known.", warnings=["Give a split or time column to compare distributions."])


# Metrics by task.
METRICS = {"imbalanced": ["pr_auc", "f1_macro", "balanced_accuracy"], "classes": ["roc_auc", "f1_macro", "accuracy"], "regression": ["mae", "rmse", "r2"], "other": ["task_specific_metric"]}


def evaluation_metric(t: Table) -> Finding:
    if t.options.objective_metric:
        return Finding("evaluation_metric", "supported", 0.95, f"The user's metric '{t.options.objective_metric}'.", {"metric": t.options.objective_metric, "source": "user_hint"})
    if t.task.kind == "unknown":
        return Finding("evaluation_metric", summary="No metric without a task.", warnings=["Give a task hint or a target column."])
    case = "other"
    if t.task.classes:
        rate = t.labels()[0].imbalance if t.roles.target else None
        case = "imbalanced" if rate is not None and rate < 0.1 else "classes"
    elif t.task.regression:
        case = "regression"
    reason = {"imbalanced": "Classes are imbalanced.", "classes": "The target holds classes.", "regression": "The target holds numbers.", "other": "The objective of this task is open."}[case]
    return Finding("evaluation_metric", "supported", 0.6, f"Metrics for {t.task.kind}.", {"recommended_metrics": METRICS[case], "rationale": [reason]}, ["Weigh the metric against the cost of errors."])


RUN: tuple[Callable[[Table], Finding], ...] = (problem_type, target_definition, data_splitting_structure, sample_size, feature_types, missingness, label_distribution, noise_level, feature_scale, correlation_structure, distribution_shift_risk, evaluation_metric)


def diagnose(df: DataFrame | None, options: Options = Options()) -> list[Finding]:
    """The twelve findings of a table, in report order."""
    if df is None or not df.columns:
        return [Finding(k, summary="There is no table.") for k in CHECKS]
    t = Table(df, options)
    if not t.n:
        return [Finding(k, summary="The table has no rows.") for k in CHECKS]
    try:
        return [check(t) for check in RUN]
    finally:
        t.done()


# What an error in each assumption puts at risk.
RISKS = {
    "task_type": "Wrong model family and evaluation.", "target_column": "Metrics measure the wrong thing.", "split_column": "Validation rows leak into training.", "time_column": "The future leaks into training.",
    "group_column": "Entities leak across splits.", "objective_metric": "The wrong thing is optimised.", "feature_array": "The design matrix is wrong.", "target_array": "Labels are misaligned.",
}


def assumptions(findings: list[Finding], options: Options = Options(), npz: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """What the findings take for granted: unresolved, to be verified, or sure enough to be accepted."""
    by = {f.key: f for f in findings}
    problem, target, split, metric = (by[k] for k in ("problem_type", "target_definition", "data_splitting_structure", "evaluation_metric"))
    column = target.evidence.get("target_column") or problem.evidence.get("target_column")
    advised = metric.evidence.get("recommended_metrics")
    rows: list[tuple[str, Any, float, str, list[str]]] = [
        ("task_type", problem.evidence.get("task_type"), problem.confidence, "problem_type", [f"source: {problem.evidence.get('inference_source')}"]),
        ("target_column", column, max(target.confidence, 0.9 * problem.confidence if column else 0.0), "target_definition", [f"conflict rate: {target.evidence.get('collision_noise_rate')}"]),
        ("split_column", split.evidence.get("split_column"), split.confidence, "data_splitting_structure", [f"structure: {split.evidence.get('structure')}"]),
        *[(k, split.evidence.get(k), split.confidence if split.evidence.get(k) else 0.0, "data_splitting_structure", [f"structure: {split.evidence.get('structure')}"]) for k in ("time_column", "group_column")],
        ("objective_metric", advised[0] if advised else metric.evidence.get("metric"), metric.confidence, "evaluation_metric", [f"advised: {advised}"]),
    ]
    if npz is not None:
        for key, sure in (("feature_array", 0.95), ("target_array", 0.8)):
            rows.append((key, npz.get(key), sure if npz.get(key) else 0.0, "npz_tabular_preview", [f"shape: {npz.get('feature_shape')}"]))
    state = lambda v, c: "unresolved" if v in (None, "") else "auto_accept" if c >= options.auto_accept else "needs_user_verification"
    return [{"key": k, "value": v, "confidence": round(c, 3), "status": state(v, c), "source": s, "evidence": e, "risk_if_wrong": RISKS[k]} for k, v, c, s, e in rows]
