"""One-pass column aggregates: missingness, scale, labels, outliers, sizes, types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import is_numeric, missing, number, present, skewness, text_of
from siftwell.operators.quantiles import held_at_once, quantiles

LIMIT = 20_000_000


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [c for c, k in kinds(df).items() if is_numeric(k) and c not in without]


def per_column(df: DataFrame, made: dict[str, dict[str, Column]]) -> DataFrame:
    """One wide aggregate over df, unpivoted to a row a column: made[column][field] is an aggregate."""
    cells = [F.struct(F.lit(name).alias("column"), *[c.alias(f) for f, c in fields.items()]).alias(f"_{i}") for i, (name, fields) in enumerate(made.items())]
    wide = df.agg(*cells)
    return wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(made))])))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_rows, n_missing, missing_rate)"""
    k = kinds(df)
    return per_column(df, {c: {"n_rows": F.count(F.lit(1)), "n_missing": F.count_if(missing(c, k[c])), "missing_rate": F.avg(missing(c, k[c]).cast("int"))} for c in columns or df.columns})


def overall_missing(df: DataFrame) -> DataFrame:
    """(overall_missing_rate): missing cells over all cells."""
    k = kinds(df)
    cells = sum([F.count_if(missing(c, k[c])) for c in df.columns], F.lit(0))
    return df.agg((cells / F.greatest(F.count(F.lit(1)) * len(df.columns), F.lit(1))).alias("overall_missing_rate"))


def feature_scale(df: DataFrame, columns: Sequence[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """(column, n, min, max, std, q05, q95, skew, heavy_tail, log_candidate) of numeric columns."""
    k = kinds(df)
    names = list(columns or numeric_columns(df))
    values = {c: number(c, k[c]) for c in names}
    made = {c: {"n": F.count(x), "min": F.min(x), "max": F.max(x), "std": F.coalesce(F.stddev_pop(x), F.lit(0.0)), "skew": skewness(x)} for c, x in values.items()}
    if few_rows(df, limit, len(values)):
        for c, x in values.items():
            both = F.percentile(x, F.array(F.lit(0.05), F.lit(0.95)))
            made[c] |= {"q05": both[0], "q95": both[1]}
    else:
        q = quantiles(df, values, [0.05, 0.95], limit)
        for c in names:
            made[c] |= {"q05": F.lit(q[c][0]).cast("double"), "q95": F.lit(q[c][1]).cast("double")}
    rows = per_column(df, made)
    log = (F.col("q05") > 0) & (F.col("q95") / F.greatest("q05", F.lit(1e-9)) > 100) & (F.col("skew") > 1)
    return rows.select("column", "n", "min", "max", "std", "q05", "q95", "skew", (F.abs("skew") > 2).alias("heavy_tail"), F.coalesce(log, F.lit(False)).alias("log_candidate"))


def few_rows(df: DataFrame, limit: int, columns: int = 1) -> bool:
    """Whether df is small enough for the percentiles of so many columns; parquet answers from its footers."""
    return held_at_once(df.count(), columns, limit)


def scale_ratios(scale: DataFrame) -> DataFrame:
    """(n_features, std_scale_ratio, range_scale_ratio, orders_of_magnitude_span) from feature_scale."""
    std, span = F.when(F.col("std") > 0, F.col("std")), F.when(F.col("max") > F.col("min"), F.col("max") - F.col("min"))
    ratio = lambda x: F.when(F.count(x) >= 2, F.max(x) / F.min(x))
    return scale.agg(F.count(F.lit(1)).alias("n_features"), ratio(std).alias("std_scale_ratio"), ratio(span).alias("range_scale_ratio"), F.log10(ratio(span)).alias("orders_of_magnitude_span"))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """(column, n, q1, q3, outlier_rate): beyond 1.5 interquartile ranges; null under 8 values, 0 without range."""
    k = kinds(df)
    values = {c: number(c, k[c]) for c in columns or numeric_columns(df)}
    q = quantiles(df, values, [0.25, 0.75], limit)
    made = {}
    for c, x in values.items():
        q1, q3 = q[c]
        if q1 is None:
            made[c] = {"n": F.count(x), "q1": F.lit(None).cast("double"), "q3": F.lit(None).cast("double"), "outlier_rate": F.lit(None).cast("double")}
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        rate = F.avg(((x < lo) | (x > hi)).cast("int")) if q3 > q1 else F.lit(0.0)
        made[c] = {"n": F.count(x), "q1": F.first(F.lit(q1)), "q3": F.first(F.lit(q3)), "outlier_rate": F.when(F.count(x) >= 8, rate)}
    return per_column(df, made)


def class_counts(df: DataFrame, target: str, nulls: bool = False) -> DataFrame:
    """(label, n): classes as text; with nulls, missing targets are a class too."""
    k = kinds(df)[target]
    rows = df if nulls else df.where(present(target, k).isNotNull())
    return rows.groupBy(text_of(target, k).alias("label")).agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(classes, total, minority_rate, imbalance_ratio, rare_event, long_tail)"""
    n = F.col("n")
    return class_counts(df, target).agg(
        F.count("*").alias("classes"), F.sum(n).alias("total"), (F.min(n) / F.greatest(F.sum(n), F.lit(1))).alias("minority_rate"), (F.max(n) / F.greatest(F.min(n), F.lit(1))).alias("imbalance_ratio"),
        (F.min(n) / F.greatest(F.sum(n), F.lit(1)) < 0.05).alias("rare_event"), ((F.count("*") >= 10) & (F.max(n) / F.greatest(F.sum(n), F.lit(1)) < 0.5)).alias("long_tail"),
    )


def value_distribution(df: DataFrame, target: str, limit: int = LIMIT) -> DataFrame:
    """(count, mean, std, q01, q50, q99, skew) of a numeric target."""
    x = number(target, kinds(df)[target])
    if few_rows(df, limit):
        q = F.percentile(x, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
        parts = [q[0], q[1], q[2]]
    else:
        parts = [F.lit(v).cast("double") for v in quantiles(df, {"x": x}, [0.01, 0.5, 0.99], limit)["x"]]
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"), *[p.alias(n) for p, n in zip(parts, ("q01", "q50", "q99"), strict=True)], skewness(x).alias("skew"))


def size_columns(rows: Column, features: int) -> list[Column]:
    """n_rows, d_features, n_over_d, regime and regularization of so many rows."""
    ratio = rows / F.lit(max(1, features))
    regime = F.when(ratio < 5, "low_data_high_d").when(ratio < 20, "moderate_data_medium_d").otherwise("data_adequate_for_many_models")
    weight = F.when(ratio < 5, "mandatory").when(ratio < 20, "recommended").otherwise("task_dependent")
    return [rows.alias("n_rows"), F.lit(features).cast("long").alias("d_features"), ratio.alias("n_over_d"), regime.alias("regime"), weight.alias("regularization")]


def sample_size(df: DataFrame, target: str | None) -> DataFrame:
    """(n_rows, d_features, n_over_d, regime, regularization)"""
    return df.agg(*size_columns(F.count(F.lit(1)), len([c for c in df.columns if c != target])))


def metric_imbalance(df: DataFrame, target: str) -> DataFrame:
    """(classes, imbalance): smallest class over all rows, missing targets being a class; null for one class."""
    n = F.col("n")
    return class_counts(df, target, nulls=True).agg(F.count("*").alias("classes"), F.when(F.count("*") >= 2, F.min(n) / F.sum(n)).alias("imbalance"))


def fact_columns(df: DataFrame, names: Sequence[str], texts: dict[str, Column] | None = None) -> dict[str, dict[str, Column]]:
    """The aggregates behind column_facts, but for distinct counts. texts: where the columns' texts (text_of) stand ready.

    Of numbers only whole ones can look like truth values, and none like lists of labels; dates and times like neither."""
    k, plain = kinds(df), {}
    for c in names:
        kind, value, text = k[c], present(c, k[c]), texts[c] if texts else text_of(c, k[c])
        nested, dated = isinstance(kind, (T.ArrayType, T.StructType, T.MapType)), isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        shown = F.when(value.isNotNull(), text)
        if isinstance(kind, T.BooleanType):
            truth = F.lit(True)
        elif is_numeric(kind):
            integral = isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and not kind.scale
            truth = F.coalesce(F.bool_and(value.isin(0, 1)), F.lit(False)) if integral else F.lit(False)
        elif dated:
            truth = F.lit(False)
        else:
            truth = F.coalesce(F.bool_and(F.lower(shown).isin("0", "1", "true", "false", "yes", "no")), F.lit(False))
        x = number(c, kind) if is_numeric(kind) else F.lit(None).cast("double")
        plain[c] = {
            "kind": F.lit("boolean" if isinstance(kind, T.BooleanType) else "number" if is_numeric(kind) else "sequence" if isinstance(kind, T.ArrayType) else "object" if nested else "datetime" if dated else "string"),
            "n_rows": F.count(F.lit(1)), "n_present": F.count(value), "bool_like": truth,
            "whole": F.coalesce(F.bool_and(x % 1 == 0), F.lit(False)) if is_numeric(kind) else F.lit(False),
            "date_rate": F.lit(1.0) if dated else F.coalesce(F.avg(F.try_to_timestamp(value).isNotNull().cast("int")), F.lit(0.0)) if isinstance(kind, T.StringType) else F.lit(0.0),
            "label_like": F.lit(0.0) if is_numeric(kind) or dated else F.coalesce(F.avg(shown.rlike("[,|;]").cast("int")), F.lit(0.0)),
            "mean_length": F.coalesce(F.avg(F.length(shown)), F.lit(0.0)),
        }
    return plain


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, n_distinct): exact, nulls and NaN apart. Rows expand once a column, with a partial aggregate before the shuffle.

    Whole numbers, dates and times are compared as long, reals as double, all else as text, so that few values are written out."""
    k, cells = kinds(df), []
    for i, c in enumerate(names):
        kind, value = k[c], present(c, k[c])
        whole, real, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(kind, T.IntegralType):
            whole = value.cast("long")
        elif isinstance(kind, T.TimestampType):
            whole = F.unix_micros(value)
        elif isinstance(kind, T.DateType):
            whole = F.unix_date(value).cast("long")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            # zeros of both signs are one double, but two texts
            real, text = value.cast("double"), F.when(value == 0, value.cast("string"))
        else:
            text = F.to_json(F.col(f"`{c}`")) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), whole.alias("whole"), real.alias("real"), text.alias("text")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long")
    # one row for each column and value, then counts: no task holds a whole column
    values = df.select(F.inline(F.array(*cells))).where("whole is not null or real is not null or text is not null").groupBy("i", "whole", "real", "text").agg(F.lit(1).alias("one"))
    return values.groupBy("i").agg(F.count("*").alias("n_distinct")).select(F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1).alias("column"), "n_distinct")


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, n_present, n_distinct, bool_like, whole, date_rate, label_like, mean_length): what typing and target choice need."""
    names = list(columns or df.columns)
    facts = per_column(df, fact_columns(df, names))
    return facts.join(distinct_counts(df, names), "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
