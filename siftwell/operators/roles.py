"""Column roles, task, and feature types, decided from names and per-column facts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.context import Options
from siftwell.functions import normalised_name

# Names by which roles are known, in order of preference.
TARGETS = ("target", "label", "y", "class", "outcome", "response", "dependent", "status", "unstable")
TIMES = ("timestamp", "datetime", "date", "time", "event_time", "created_at", "ts")
SPLITS = ("split", "dataset_split", "set", "fold")
GROUPS = ("group", "entity_id", "user_id", "customer_id", "account_id", "session_id")
TARGET_WORDS = ("target", "label", "class", "outcome", "response", "status", "unstable")
LEAK_WORDS = ("future", "next_", "lead_", "t_plus", "label", "target")
AGGREGATE_WORDS = ("avg", "mean", "sum", "count", "rate", "rolling")
TASKS = {
    "binary": "binary_classification", "binary_classification": "binary_classification", "classification": "multiclass_classification", "multiclass": "multiclass_classification",
    "multiclass_classification": "multiclass_classification", "multilabel": "multilabel_classification", "multilabel_classification": "multilabel_classification", "regression": "regression", "ranking": "ranking", "survival": "survival",
}
LEAST_SCORE = 2.5


def plain_name(name: object) -> str:
    return re.sub("[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def matching(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """The first column that has one of these names, the names' order deciding."""
    by_name: dict[str, str] = {}
    for c in columns:
        by_name.setdefault(plain_name(c), c)
    return next((by_name[plain_name(n)] for n in names if plain_name(n) in by_name), None)


def id_columns(columns: Iterable[str], hints: Iterable[str] = ()) -> list[str]:
    columns = list(columns)
    found = {c for h in hints if (c := matching(columns, [h]))}
    return sorted(found | {c for c in columns if (n := plain_name(c)) in ("id", "uuid") or n.endswith("_id") or "identifier" in n})


def leak_suspects(target: str, features: Iterable[str]) -> list[str]:
    """Features whose name holds the target's name or a word of the future."""
    t = plain_name(target)
    return sorted({c for c in features if (n := plain_name(c)) and (t and t in n and n != t or any(w in n for w in LEAK_WORDS))})


def score_of() -> Column:
    """How much a column of column_facts looks like the target; null for columns without values."""
    name, n, u = normalised_name(F.col("column")), F.col("n_present"), F.col("n_distinct")
    part = lambda share, least: F.greatest(F.lit(least), F.floor(n * share))
    rules: list[Column] = [
        F.when(name.isin("target", "label", "y"), 8.0),
        F.when(name.rlike("|".join(TARGET_WORDS)), 4.0),
        F.when(name.rlike(r"^f\d+$"), -3.0),
        F.when(name.isin("split", "fold") | name.rlike("time|date"), -4.0),
        F.when(name.endswith("_id") | name.isin("id", "row_id", "entity_id"), -6.0),
        F.when(F.col("bool_like"), 3.0)
        .when(F.col("kind") == "number", 1.0 + F.when(u <= 2, 2.5).when(u <= part(0.02, 10), 1.2).when(u >= F.floor(n * 0.6), -2.0).otherwise(0.0))
        .otherwise(F.when(u <= part(0.08, 20), 1.8).when(u >= F.floor(n * 0.8), -2.0).otherwise(0.0)),
        F.when(u <= 1, -5.0),
    ]
    return F.when(n > 0, sum([F.coalesce(r, F.lit(0.0)) for r in rules], F.lit(0.0)))


def target_scores(facts: DataFrame) -> DataFrame:
    """(column, score) of the columns with values; facts are column_facts of the candidates."""
    return facts.where("n_present > 0").select("column", score_of().alias("score"))


def feature_type_of(compat: bool = True) -> Column:
    """The type of a column of column_facts. With compat, five or more numbers count as dates, because they parse as such."""
    n, u = F.col("n_present"), F.col("n_distinct")
    number = F.col("kind") == "number"
    dated = (F.col("kind") == "datetime") | (n >= 5) & ((F.col("date_rate") >= 0.8) | number & F.lit(compat))
    discrete = F.col("whole") & (u <= F.greatest(F.lit(30), F.floor(F.greatest(n, F.lit(1)) * 0.05)))
    wordy = (F.col("mean_length") > 40) | (F.col("mean_length") > 16) & (u / F.greatest(n, F.lit(1)) > 0.6)
    return (
        F.when(F.col("bool_like"), "boolean").when(dated, "datetime").when(number & (n == 0), "numeric_unknown").when(number & discrete, "numeric_discrete").when(number, "numeric_continuous")
        .when(n == 0, "unknown").when(F.col("kind") == "sequence", "sequence").when(F.col("kind") == "object", "object").when(wordy, "text").otherwise("categorical_nominal")
    )


def feature_types(facts: DataFrame, compat: bool = True) -> DataFrame:
    """(column, feature_type)"""
    return facts.select("column", feature_type_of(compat).alias("feature_type"))


def task_of() -> Column:
    """Task and confidence (col1, col2) if a column of column_facts were the target."""
    n, u = F.col("n_present"), F.col("n_distinct")
    number, many = F.col("kind") == "number", F.col("label_like") >= 0.6
    few = F.col("whole") & (u <= F.greatest(F.lit(20), F.floor(n * 0.1)))
    return (
        F.when(n == 0, F.struct(F.lit("unknown"), F.lit(0.0))).when(many, F.struct(F.lit("multilabel_classification"), F.lit(0.65)))
        .when(number & (u <= 2), F.struct(F.lit("binary_classification"), F.lit(0.9))).when(number & few, F.struct(F.lit("multiclass_classification"), F.lit(0.7))).when(number, F.struct(F.lit("regression"), F.lit(0.75)))
        .when(u <= 2, F.struct(F.lit("binary_classification"), F.lit(0.85))).otherwise(F.struct(F.lit("multiclass_classification"), F.lit(0.8)))
    )


def tasks(facts: DataFrame) -> DataFrame:
    """(column, task_type, confidence) if the column were the target."""
    return facts.select("column", task_of()["col1"].alias("task_type"), task_of()["col2"].alias("confidence"))


@dataclass(frozen=True)
class Roles:
    target: str | None
    time: str | None
    split: str | None
    group: str | None
    ids: tuple[str, ...]

    @classmethod
    def of(cls, columns: list[str], options: Options) -> Roles:
        """Roles by hints and names; a hint that fits no column is passed over."""
        pick = lambda hint, names: matching(columns, [*([hint] if hint else []), *names])
        return cls(pick(options.target_column, TARGETS), pick(options.time_column, TIMES), pick(options.split_column, SPLITS), pick(options.group_column, GROUPS), tuple(id_columns(columns, options.id_columns)))


@dataclass(frozen=True)
class Task:
    kind: str
    confidence: float
    source: str
    temporal: bool
    multi: bool = False

    @property
    def classes(self) -> bool:
        return self.kind in ("binary_classification", "multiclass_classification", "multilabel_classification")

    @property
    def regression(self) -> bool:
        return self.kind == "regression"


def hinted_task(roles: Roles, hint: str) -> Task:
    name = hint.strip().lower().replace("-", "_").replace(" ", "_")
    return Task(TASKS.get(name, name), 0.95, "task_hint", bool(roles.time), bool(roles.target and "," in roles.target))


def best_target(scores: Mapping[str, float], columns: list[str]) -> str | None:
    """The column of the highest score, the first one among equals, if the score is high enough."""
    ranked = [c for c in columns if c in scores]
    best = max(ranked, key=lambda c: scores[c], default=None)
    return best if best is not None and scores[best] >= LEAST_SCORE else None
