"""Relations between columns and rows: correlation, informative missingness, duplicates, conflicts, leakage, shift."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siftwell.functions import correlation, missing, number, present, text_of
from siftwell.operators.profile import LIMIT, kinds, numeric_columns, per_column
from siftwell.operators.quantiles import nth_smallest

#: Up to so many columns pairs are SQL aggregates; more go through moment matrices.
FEW_COLUMNS = 6
#: Features that make a row's signature.
SIGNED_COLUMNS = 20


def pair_frame(df: DataFrame, pairs: list[tuple[str, str]], made: dict[tuple[str, str], Column], field: str) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), made[a, b].alias(field)) for a, b in pairs]
    if not cells:
        return df.sparkSession.createDataFrame([], f"a string, b string, {field} double")
    return df.agg(*[c.alias(f"_{i}") for i, c in enumerate(cells)]).select(F.inline(F.array(*[f"_{i}" for i in range(len(cells))])))


def corr_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr) of all pairs of numeric columns, over rows where both are present; null for constants."""
    k = kinds(df)
    names = list(columns or numeric_columns(df))
    values = {c: number(c, k[c]) for c in names}
    if len(names) <= FEW_COLUMNS:
        pairs = list(itertools.combinations(names, 2))
        return pair_frame(df, pairs, {(a, b): correlation(values[a], values[b]) for a, b in pairs}, "corr")
    return wide_corr(df.select(F.array(*values.values()).alias("v")), names)


def wide_corr(rows: DataFrame, names: list[str]) -> DataFrame:
    """corr of all pairs from pairwise moments; rows hold one array of doubles, null where missing.

    Each task sums d x d moment matrices around a common centre and sends them row by row,
    so what is shuffled is tasks x d rows of 5 d numbers, however many rows there are.
    """
    d = len(names)
    means = rows.select(*[F.avg(F.col("v")[i]).alias(str(i)) for i in range(d)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])

    def moments(batches):
        total = np.zeros((5, d, d))
        for batch in batches:
            flat = batch.column(0).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            there = ~np.isnan(x)
            x = np.where(there, x - centre, 0.0)
            m = there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, x.T @ x])
        rows = np.transpose(total, (1, 0, 2)).reshape(d, 5 * d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "m"])

    sums = rows.mapInArrow(moments, "i long, m array<double>").select("i", F.posexplode("m").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    got = np.zeros((d, 5, d))
    for r in sums.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("m")).collect():
        got[r.i] = np.array([x.x for x in r.m]).reshape(5, d)
    n, si, sj, sii, sij = np.transpose(got, (1, 0, 2))
    with np.errstate(all="ignore"):
        var_i, cov = sii / n - (si / n) ** 2, sij / n - (si / n) * (sj / n)
        corr = cov / np.sqrt(np.where(var_i > 0, var_i, np.nan) * np.where(var_i.T > 0, var_i.T, np.nan))
    out = [(names[i], names[j], None if np.isnan(corr[i, j]) else float(corr[i, j])) for i in range(d) for j in range(i + 1, d)]
    return rows.sparkSession.createDataFrame(out, "a string, b string, corr double")


def high_corr(pairs: DataFrame, least: float = 0.9, most: int = 50) -> DataFrame:
    """The strongest pairs, rounded to 4 places; ties by name."""
    return pairs.where(F.abs("corr") >= least).select("a", "b", F.bround("corr", 4).alias("corr")).orderBy(F.abs("corr").desc(), "a", "b").limit(most)


def missing_indicator_corr(df: DataFrame) -> DataFrame:
    """(a, b, corr) of missing indicators, of columns that are missing somewhere but not everywhere."""
    k = kinds(df)
    rates = df.agg(*[F.avg(missing(c, k[c]).cast("int")).alias(c) for c in df.columns]).first()
    names = [c for c, r in zip(df.columns, rates, strict=True) if r is not None and 0 < r < 1]
    pairs = list(itertools.combinations(names, 2))
    flag = {c: missing(c, k[c]).cast("double") for c in names}
    return pair_frame(df, pairs, {(a, b): correlation(flag[a], flag[b]) for a, b in pairs}, "corr")


def missing_target_effect(df: DataFrame, target: str) -> DataFrame:
    """(column, effect): |mean of the target where missing - where present| over its standard deviation."""
    k = kinds(df)
    y = number(target, k[target])
    made = {}
    for c in df.columns:
        if c != target:
            gone = missing(c, k[c])
            gap = F.abs(F.avg(F.when(gone, y)) - F.avg(F.when(~gone, y)))
            made[c] = {"effect": F.try_divide(gap, F.stddev_pop(y))}
    return per_column(df, made).where("effect is not null")


def missing_target_tv(df: DataFrame, target: str) -> DataFrame:
    """(column, tv): total variation between label shares where missing and where present; missing labels count as one."""
    k = kinds(df)
    names = [c for c in df.columns if c != target]
    label = text_of(target, k[target])
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"), *[F.count_if(missing(c, k[c])).alias(f"m{i}") for i, c in enumerate(names)])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), F.col(f"m{i}").alias("m")) for i, c in enumerate(names)])))
    # the totals come from the same grouped rows, one a label
    totals = long.groupBy("column").agg(F.sum("m").alias("gone"), F.sum(F.col("n") - F.col("m")).alias("there")).where("gone > 0 and there > 0")
    return long.join(totals, "column").groupBy("column").agg((0.5 * F.sum(F.abs(F.col("m") / F.col("gone") - (F.col("n") - F.col("m")) / F.col("there")))).alias("tv"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, n_distinct, duplicate_rate): rows equal to another one, nulls being equal."""
    k = kinds(df)
    key = [F.to_json(F.col(f"`{c}`")).alias(c) if k[c].typeName() in ("map", "variant") else F.col(f"`{c}`") for c in df.columns]
    groups = df.select(*key).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    n, m = F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")
    return groups.agg(n.alias("n_rows"), m.alias("n_distinct"), F.coalesce(F.try_divide(n - m, n), F.lit(0.0)).alias("duplicate_rate"))


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None, most: int = 120) -> DataFrame:
    """(a, b): pairs of a column and a later one whose values are equal as text in every row.

    Columns are grouped by sums of row hashes that a single pass takes in any order; a second
    pass compares the pairs of a group row by row. A column's pair is the first that equals it.
    """
    k = kinds(df)
    names = list(columns or df.columns)[:most]
    rows = F.xxhash64(*[text_of(c, k[c]) for c in names])
    # a sum, not a parity: equal rows must not cancel out
    hashes = df.agg(*[F.sum(F.xxhash64(rows, text_of(c, k[c])).cast("decimal(20,0)")).alias(c) for c in names]).first()
    groups: dict[object, list[str]] = {}
    for c, h in zip(names, hashes, strict=True):
        groups.setdefault(h, []).append(c)
    pairs = [p for group in groups.values() for p in itertools.combinations(group, 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string")
    differ = df.agg(*[F.count_if(text_of(a, k[a]) != text_of(b, k[b])).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    first: dict[str, str] = {}
    for (a, b), n in zip(pairs, differ, strict=True):
        if not n and a not in first:
            first.setdefault(b, a)
    at = {c: i for i, c in enumerate(names)}
    return df.sparkSession.createDataFrame(sorted(((a, b) for b, a in first.items()), key=lambda p: at[p[1]]), "a string, b string")


def conflict_rate(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(repeated, conflicting, conflict_rate): signatures of the first 20 features that repeat, and those with several targets.

    The number of targets is told by their least and greatest hash, so a hot signature
    aggregates before the shuffle.
    """
    k = kinds(df)
    sig = [text_of(c, k[c]).alias(f"_s{i}") for i, c in enumerate(list(features)[:SIGNED_COLUMNS])]
    y = present(target, k[target])
    code = F.when(y.isNotNull(), F.xxhash64(y))
    groups = df.select(*sig, code.alias("_y")).groupBy(*[f"_s{i}" for i in range(len(sig))]).agg(F.count("*").alias("n"), (F.min("_y") != F.max("_y")).alias("several"))
    again = groups.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("n") > 1) & F.col("several")).alias("conflicting"))
    return again.select("repeated", "conflicting", (F.col("conflicting") / F.greatest("repeated", F.lit(1))).alias("conflict_rate"))


def group_leakage(df: DataFrame, split: str, group: str) -> DataFrame:
    """(n_groups, n_leaked, leakage_fraction): entities seen in more than one split; null with fewer than two splits."""
    k = kinds(df)
    rows = df.where(present(split, k[split]).isNotNull() & present(group, k[group]).isNotNull()).select(text_of(split, k[split]).alias("s"), text_of(group, k[group]).alias("g"))
    groups = rows.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    total = groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_leaked"), (F.min("lo") != F.max("hi")).alias("_several"))
    return total.select("n_groups", "n_leaked", F.when(F.col("_several"), F.try_divide("n_leaked", "n_groups")).alias("leakage_fraction"))


def split_moments(df: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """(split, n_rows, column, n, mean, m2): one row for each split and column."""
    k = kinds(df)
    rows = df.where(present(split, k[split]).isNotNull()).groupBy(text_of(split, k[split]).alias("split"))
    values = {c: number(c, k[c]) for c in columns}
    wide = rows.agg(F.count("*").alias("n_rows"), *[F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")).alias(f"_{i}") for i, (c, x) in enumerate(values.items())])
    return wide.select("split", "n_rows", F.inline(F.array(*[f"_{i}" for i in range(len(values))])))


def split_shift(df: DataFrame, split: str, columns: Sequence[str] | None = None, others: int = 3) -> DataFrame:
    """(base, other, column, shift): standardised difference of means between the largest split and the next ones.

    Splits of equal size are ordered by name.  At least five values in each; all scores are
    returned, those above 0.5 count as shifted.
    """
    names = list(columns or [c for c in numeric_columns(df) if c != split][:60])
    moments = split_moments(df, split, names)
    sizes = moments.select("split", "n_rows").distinct().orderBy(F.desc("n_rows"), "split").limit(others + 1).collect()
    if len(sizes) < 2:
        return df.sparkSession.createDataFrame([], "base string, other string, column string, shift double")
    base, rest = sizes[0].split, [r.split for r in sizes[1:]]
    a = moments.where(F.col("split") == base).select("column", *[F.col(c).alias(f"{c}_a") for c in ("n", "mean", "m2")])
    b = moments.where(F.col("split").isin(rest)).select("column", F.col("split").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "m2")])
    both = a.join(b, "column").where("n_a >= 5 and n_b >= 5")
    n, gap = F.col("n_a") + F.col("n_b"), F.col("mean_a") - F.col("mean_b")
    std = F.sqrt((F.col("m2_a") + F.col("m2_b") + gap * gap * F.col("n_a") * F.col("n_b") / n) / n)
    return both.where(std > 0).select(F.lit(base).alias("base"), "other", "column", (F.abs(gap) / std).alias("shift"))


def split_shift_of(moments: Sequence[Row], base: str, others: Sequence[str]) -> list[Row]:
    """Rows (base, other, column, shift) from rows of split_moments."""
    by, out = {(m.split, m["column"]): m for m in moments}, []
    for other in others:
        for column in dict.fromkeys(m["column"] for m in moments):
            a, b = by.get((base, column)), by.get((other, column))
            if a is None or b is None or a.n < 5 or b.n < 5:
                continue
            n, gap = a.n + b.n, a.mean - b.mean
            std = math.sqrt((a.m2 + b.m2 + gap * gap * a.n * b.n / n) / n)
            if std > 0:
                out.append(Row(base=base, other=other, column=column, shift=abs(gap) / std))
    return out


def time_of(time: str, k: dict) -> Column:
    """A time column as microseconds (double); what is no time is null."""
    at = F.try_to_timestamp(F.col(f"`{time}`").cast("string")) if k[time].typeName() == "string" else F.col(f"`{time}`").cast("timestamp")
    return F.unix_micros(at).cast("double")


def at_rank(rows: DataFrame, value: str, rank: int, n: int, limit: int) -> float:
    """The value (double) at a 0-based rank among n non-null ones: up to ``limit`` rows by one aggregate, beyond by counting passes."""
    if n > limit:
        return nth_smallest(rows, F.col(value), rank)
    return rows.agg(F.expr(f"percentile_disc({(rank + 0.5) / n!r}D) WITHIN GROUP (ORDER BY {value})")).first()[0]


def time_drift(df: DataFrame, time: str, tie: str | None = None, columns: Sequence[str] | None = None, n: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(column, n_early, n_late, shift): standardised difference of means between the earlier and the later half.

    The halves are told apart by the exact middle time; rows of that very time are divided
    by ``tie`` (a numeric column, row hash if none).  No global sort or window is needed.
    n: the number of times, if it is known.
    """
    k = kinds(df)
    rows = df.withColumn("_t", time_of(time, k)).where("_t is not null")
    names = list(columns or [c for c in numeric_columns(df) if c != time])
    n = rows.count() if n is None else n
    if n < 20:
        return df.sparkSession.createDataFrame([], "column string, n_early long, n_late long, shift double")
    middle = at_rank(rows, "_t", n // 2, n, limit)
    before, among = rows.agg(F.count_if(F.col("_t") < middle), F.count_if(F.col("_t") == middle)).first()
    order = F.col(f"`{tie}`").cast("double") if tie else F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 11).cast("double")
    early = F.col("_t") < middle
    if n // 2 > before:
        cut = at_rank(rows.where(F.col("_t") == middle).select(order.alias("_o")), "_o", n // 2 - before, among, limit)
        early = early | ((F.col("_t") == middle) & (order < cut))
    made = {}
    for c in names:
        x = number(c, k[c])
        a, b = F.when(early, x), F.when(~early, x)
        made[c] = {"n_early": F.count(a), "n_late": F.count(b), "shift": F.try_divide(F.abs(F.avg(a) - F.avg(b)), F.stddev_pop(x))}
    return per_column(rows, made).where("n_early >= 5 and n_late >= 5 and shift is not null")


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1): a score at or above the threshold predicts 1.

    Scores fall into the cells between thresholds first, so rows are never multiplied.
    """
    cuts = sorted(thresholds)
    cell = F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]), lambda t: t <= F.col(score)))
    cells = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    steps = df.sparkSession.createDataFrame([(float(t), i + 1) for i, t in enumerate(cuts)], "threshold double, step int")
    sums = cells.crossJoin(F.broadcast(steps)).groupBy("threshold").agg(F.sum(F.when(F.col("cell") >= F.col("step"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") >= F.col("step"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("cell") < F.col("step"), F.col("pos")).otherwise(0)).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-12)
    return sums.select("threshold", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-12)).alias("f1"))
