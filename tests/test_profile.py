import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.operators import profile, quantiles, relations


def frame(spark, columns, schema):
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema)


def test_missing_kinds(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), " "), (None, None), (2.0, "\t"), (3.0, "b")], "x double, s string")
    rates = {r["column"]: (r.n_missing, r.missing_rate) for r in profile.missing_rates(df).collect()}
    assert rates == {"x": (2, 0.4), "s": (3, 0.6)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string, y int")
    assert profile.sample_size(df, "y").first().n_rows == 0
    assert relations.duplicate_rows(df).first().duplicate_rate == 0.0
    assert profile.iqr_outliers(df, ["x"]).first().outlier_rate is None
    assert profile.feature_scale(df, ["x"]).first().n == 0


def test_constant_column_has_no_correlation_and_no_skew(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, x double")
    assert relations.corr_pairs(df).first()["corr"] is None
    scale = {r["column"]: r for r in profile.feature_scale(df).collect()}
    assert scale["c"].skew == 0.0 and scale["c"].std == 0.0


def test_correlation_with_nulls_equals_pandas(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(size=(50, 3)), columns=list("abc"))
    data = data.mask(rng.random(data.shape) < 0.2)
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in data.values], "a double, b double, c double")
    want = data.corr()
    for r in relations.corr_pairs(df).collect():
        assert r["corr"] == pytest.approx(want.loc[r.a, r.b], abs=1e-9)
    wide = relations.wide_corr(df.select(F.array("a", "b", "c").alias("v")), list("abc"))
    for r in wide.collect():
        assert r["corr"] == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_few_values_have_no_outlier_rate(spark):
    df = spark.createDataFrame([(float(i),) for i in range(7)], "x double")
    assert profile.iqr_outliers(df).first().outlier_rate is None


def test_outliers_equal_pandas(spark):
    s = pd.Series([*range(20), 1000.0, -1000.0])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    want = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).mean()
    assert profile.iqr_outliers(spark.createDataFrame([(float(v),) for v in s], "x double")).first().outlier_rate == pytest.approx(want)


@pytest.mark.parametrize("limit", [10, 10**9])
def test_selected_quantiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(100, 400), np.full(50, 7.0)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = quantiles.quantiles(df, {"x": F.col("x")}, [0.0, 0.05, 0.5, 0.95, 1.0], limit)["x"]
    assert got == pytest.approx(np.quantile(x, [0.0, 0.05, 0.5, 0.95, 1.0]))


def test_drift_halves_with_ties(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(days=i // 10), i, float(i)) for i in range(41)]
    df = spark.createDataFrame(rows, "t timestamp, k long, x double")
    r = relations.time_drift(df, "t", "k", ["x"]).first()
    x = np.arange(41.0)
    assert (r.n_early, r.n_late) == (20, 21)
    assert r["shift"] == pytest.approx(abs(x[:20].mean() - x[20:].mean()) / x.std())


def test_under_twenty_rows_there_is_no_drift(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), float(i)) for i in range(19)], "t timestamp, x double")
    assert relations.time_drift(df, "t").count() == 0


def test_duplicate_columns_need_equal_rows(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (None, None, 3)], "a int, b int, c int")
    assert [tuple(r) for r in relations.duplicate_columns(df).collect()] == [("a", "b")]


def test_conflicts_ignore_missing_targets(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", None), ("z", 1)], "f string, y int")
    assert tuple(relations.conflict_rate(df, "y", ["f"]).first()) == (2, 1, 0.5)


def test_leakage_needs_two_splits(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2)], "s string, g int")
    assert relations.group_leakage(one, "s", "g").first().leakage_fraction is None
    two = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "s string, g int")
    assert relations.group_leakage(two, "s", "g").first().leakage_fraction == 0.5


def test_shift_is_invariant_to_row_order(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", float(i) + 5) for i in range(8)]
    get = lambda r: [(x.other, round(x["shift"], 9)) for x in relations.split_shift(spark.createDataFrame(r, "s string, x double"), "s").collect()]
    assert get(rows) == get(rows[::-1])


def test_selected_quantiles_of_many_columns_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 3))
    x[:, 1], x[:, 2] = np.round(x[:, 1], 1), np.exp(5 * x[:, 2])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    passes, narrowed = [], quantiles.narrowed
    monkeypatch.setattr(quantiles, "narrowed", lambda rows, ranges: passes.append(len(ranges)) or narrowed(rows, ranges))
    monkeypatch.setattr(quantiles, "FEW", 64)
    got = quantiles.quantiles(df, {c: F.col(c) for c in "abc"}, [0.0, 0.25, 0.5, 0.99], 10)
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(np.quantile(x[:, i], [0.0, 0.25, 0.5, 0.99]))
    assert len(passes) <= 6


def test_duplicate_columns_where_rows_repeat(spark):
    rows = [(i, i % 3, i % 3, str(i % 3), i % 3 if i else 7, -i) for i in range(8)] * 2
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int, f int")
    assert [tuple(r) for r in relations.duplicate_columns(df).collect()] == [("b", "c"), ("b", "d")]


def jobs_of(spark, work):
    """How many Spark SQL executions work takes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    return store.executionsCount() - before


@pytest.mark.parametrize("columns", [3, 20])
def test_a_diagnosis_scans_a_few_times_whatever_the_columns(spark, columns):
    from siftwell.context import Options
    from siftwell.plans.diagnose import diagnose

    rows = spark.range(400).select(*[((F.col("id") * (i + 3)) % (i + 11)).cast("double").alias(f"c{i}") for i in range(columns)], F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("holes"), (F.col("id") % 2).alias("label"), F.concat(F.lit("s"), F.col("id") % 3).alias("split"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 50).alias("user_id"))
    findings = []
    count = jobs_of(spark, lambda: findings.extend(diagnose(rows, Options())))
    assert all(f.status == "supported" for f in findings)
    assert count <= 20, count


@pytest.mark.parametrize("held", [10, 1 << 23])
def test_no_task_holds_more_values_than_allowed_for_percentiles(spark, monkeypatch, held):
    """Few rows of many values are too much for one task too; then ranks are selected, a row giving a cell a column whatever the ranges."""
    rng = np.random.default_rng(11)
    x = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 40, 900).astype(float), "c": 10.0 ** rng.integers(-8, 9, 900)})
    monkeypatch.setattr(quantiles, "HELD", held)
    monkeypatch.setattr(quantiles, "FEW", 16)
    monkeypatch.setattr(quantiles, "BUCKETS", 32)
    if held < len(x):
        monkeypatch.setattr(quantiles.F, "percentile", lambda *_: pytest.fail("one task would hold all values"))
    cells, array = [], F.array
    monkeypatch.setattr(quantiles.F, "array", lambda *c: cells.append(len(c)) or array(*c))
    shares = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    df = spark.createDataFrame(x)
    got = quantiles.quantiles(df, {c: F.col(c) for c in x}, shares, 20_000_000)
    assert all(np.allclose(got[c], x[c].quantile(shares).tolist()) for c in x)
    assert max(cells[1:], default=0) <= 3
    stats = {r["column"]: r for r in profile.feature_scale(df).collect()}
    assert all(math.isclose(stats[c].q95, x[c].quantile(0.95)) for c in x)


def test_a_key_settles_repeated_rows_and_conflicts(spark, monkeypatch):
    from siftwell.context import Options
    from siftwell.plans.diagnose import diagnose

    df = spark.range(60).selectExpr("id AS width", "id % 3 AS x", "CAST(id % 2 AS STRING) AS y")
    options = Options(target_column="y")
    whole = {f.key: f.evidence for f in diagnose(df, options)}
    rows = {f.key: f.evidence for f in diagnose(df.drop("width"), options)}
    assert whole["data_splitting_structure"]["duplicate_row_rate"] == 0.0 and whole["noise_level"]["label_conflict_proxy"] == 0.0
    assert rows["data_splitting_structure"]["duplicate_row_rate"] == 0.9 and rows["noise_level"]["label_conflict_proxy"] == 1.0
    # one null, or one repeated value, makes no key
    for holes in (df.selectExpr("nullif(width, 5) AS width", "x", "y"), df.selectExpr("greatest(width, 1) AS width", "x", "y")):
        seen = []
        with monkeypatch.context() as m:
            for name in ("duplicate_rows", "conflict_rate"):
                m.setattr(relations, name, lambda *a, f=getattr(relations, name), name=name: seen.append(name) or f(*a))
            diagnose(holes, options)
        assert sorted(seen) == ["conflict_rate", "duplicate_rows"]
    for name in ("duplicate_rows", "conflict_rate"):
        monkeypatch.setattr(relations, name, lambda *_: pytest.fail("a key settles this"))
    assert {f.key: f.evidence for f in diagnose(df, options)} == whole


def test_distinct_values_are_told_apart_by_type(spark):
    """Values are compared as what they are: two instants of one local time are two, nulls and NaN are none."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        # the hour from 2:00 to 3:00 that clocks ran through twice
        df = spark.sql("SELECT timestamp_micros(1603584000000000 + 1800000000 * cast(id % 4 AS BIGINT)) AS at, IF(id < 5, double('NaN'), id % 3) AS x, cast(IF(id = 9, NULL, id) AS SMALLINT) AS n, cast(id % 4 AS STRING) AS s, date_add(DATE'2020-01-01', int(id % 2)) AS d, id % 2 = 0 AS b, cast(id % 3 AS DECIMAL(5, 2)) AS dec, cast(id % 5 AS FLOAT) AS f, array(id % 2) AS arr, cast(NULL AS INT) AS gone FROM range(10)")
        counts = {r["column"]: r.n_distinct for r in profile.distinct_counts(df, df.columns).collect()}
        assert len({r[0] for r in df.select(F.col("at").cast("string")).collect()}) < 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert counts == {"at": 4, "x": 3, "n": 9, "s": 4, "d": 2, "b": 2, "dec": 3, "f": 5, "arr": 2}
    assert profile.distinct_counts(df, []).count() == 0
