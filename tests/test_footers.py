"""Profiles from footers, and mergeable states of files."""

import datetime
import decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from siftwell.plans import states
from siftwell.sources import footers, ranges


def told(df):
    return {r.column: tuple(r)[1:-1] for r in df.collect()}


@pytest.mark.parametrize("name", ["lineitem", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"])
def test_footers_say_what_a_scan_says(spark, name):
    path = f"{SMALL}/{name}.parquet"
    df = spark.read.parquet(path)
    got = footers.footer_profile(spark, path)
    assert told(got) == told(footers.scanned(df, df.columns))
    assert any(r.from_footers for r in got.collect())


def test_types_and_gaps(spark, tmp_path):
    day, at = datetime.date(1969, 7, 20), datetime.datetime(1969, 7, 20, 20, 17, 40, 123456)
    table = pa.table({
        "i": pa.array([3, None, -5], pa.int32()), "b": pa.array([True, None, False]), "d": pa.array([day, None, day + datetime.timedelta(9)]),
        "ms": pa.array([at, None, None], pa.timestamp("ms")), "us": pa.array([at, at, None], pa.timestamp("us", "UTC")), "f": pa.array([float("nan"), -0.0, None]),
        "all_nan": pa.array([float("nan")] * 3), "none": pa.array([None] * 3, pa.string()), "s": pa.array(["é", "", "z"]), "long": pa.array(["a" * 70, "b", None]),
        "dec": pa.array([decimal.Decimal("1.25"), None, decimal.Decimal("-7.50")]), "raw": pa.array([b"x", None, b""]), "list": pa.array([[1, None], None, []], pa.list_(pa.int64())),
    })
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=2)
    pq.write_table(table.drop_columns(["s", "i"]), tmp_path / "two.parquet", row_group_size=1)
    pq.write_table(table, tmp_path / "three.parquet", write_statistics=["i", "b"])
    for files, whole in ((["one"], {"i", "b", "d", "us", "none", "s", "dec", "raw"}), (["one", "two"], {"i", "s", "b", "d", "none", "raw"}), (["one", "two", "three"], {"i", "b"})):
        folder = tmp_path / "-".join(files)
        folder.mkdir()
        for f in files:
            (folder / f"{f}.parquet").write_bytes((tmp_path / f"{f}.parquet").read_bytes())
        df = spark.read.parquet(str(folder))
        got = footers.footer_profile(spark, str(folder))
        assert told(got) == told(footers.scanned(df, df.columns))
        assert whole <= {r.column for r in got.collect() if r.from_footers}
        assert not {"all_nan", "long", "list"} & {r.column for r in got.collect() if r.from_footers}
    assert told(got)["us"][2] == -14182939876544 and told(got)["i"][:4] == (9, 5, -5, 3)


def test_no_data_is_read(spark, tmp_path):
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).substr(1, 40).alias("name")).repartition(3).write.parquet(str(tmp_path / "t"))
    files = ranges.list_files(spark, str(tmp_path / "t"))
    read = footers.footer_rows(files, spark.read.parquet(str(tmp_path / "t")).schema).agg(F.sum("n_read").alias("n")).first().n
    assert read < 20_000 < 1_000_000 < files.agg(F.sum("length").alias("n")).first().n
    assert all(r.from_footers for r in footers.footer_profile(spark, str(tmp_path / "t")).collect())


def test_empty_tables_and_other_files(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([], pa.int64()), "s": pa.array([], pa.string())}), tmp_path / "e.parquet")
    got = told(footers.footer_profile(spark, str(tmp_path)))
    assert got == {"a": (0, 0, *[None] * 6), "s": (0, 0, *[None] * 6)}
    (tmp_path / "text").write_text("not a table")
    with pytest.raises(ValueError, match="footer"), ranges.Ranged(str(tmp_path / "text")) as f:
        footers.footer(f)


# states ---------------------------------------------------------------------


def exact(profile):
    return {r.column: (r.n_rows, r.n_missing, r.low_whole, r.high_whole, r.low_real, r.high_real, r.low_text, r.high_text) for r in profile.collect()}


def test_states_of_parts_equal_the_state_of_all(spark, tmp_path):
    rows = [(i, float("nan") if i % 11 == 0 else i * 0.37 - 900, None if i % 5 == 0 else " " if i % 7 == 0 else f"n{i % 83}", (1 << 62) + i, [i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, x double, file string, big long, deep array<int>")
    folder, store = str(tmp_path / "rows"), str(tmp_path / "store")
    for lot, part in enumerate((df.where("i < 400"), df.where("i >= 400 and i < 2900").repartition(3), df.where("i >= 2900"))):
        part.write.mode("append").parquet(folder)
        found = states.refresh(spark, folder, store)
        assert spark.read.parquet(store).select("file").distinct().count() == spark.read.parquet(folder).select("_metadata.file_path").distinct().count(), lot
    at_once = states.finished(states.merged(states.column_states(df, df.columns, F.lit("all"))))
    assert exact(found) == exact(at_once)
    got, want = {r.column: r for r in found.collect()}, {r.column: r for r in at_once.collect()}
    assert got["big"].mean == want["big"].mean and got["file"].mean is None
    assert all(got[c].std == pytest.approx(want[c].std, rel=1e-9) and got[c].mean == pytest.approx(want[c].mean, rel=1e-9) for c in ("i", "x"))
    assert got["x"].std == pytest.approx(df.where("not isnan(x)").agg(F.stddev_pop("x")).first()[0], rel=1e-9)
    true = {"i": 3000, "x": 2727, "file": 83, "big": 3000, "deep": 3}
    assert all(got[c].n_distinct == pytest.approx(n, rel=0.06) for c, n in true.items())


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    folder, store = tmp_path / "rows", str(tmp_path / "store")
    folder.mkdir()
    pq.write_table(pa.table({"a": [1, 2], "b": ["x", None]}), folder / "one [1] {2}.parquet")
    pq.write_table(pa.table({"a": [5]}), folder / "two.parquet")
    assert exact(states.refresh(spark, str(folder), store))["a"][:4] == (3, 0, 1, 5)
    before = spark.read.parquet(store).count()
    assert exact(states.refresh(spark, str(folder), store))["b"][:2] == (3, 2) and spark.read.parquet(store).count() == before
    pq.write_table(pa.table({"a": [7, 8, 9]}), folder / "two.parquet")
    assert exact(states.refresh(spark, str(folder), store))["a"][:4] == (5, 0, 1, 9)
    assert spark.read.parquet(store).count() == before + 1
    spark.read.parquet(store).write.mode("append").parquet(store + "-twice")
    spark.read.parquet(store).write.mode("append").parquet(store + "-twice")
    assert exact(states.refresh(spark, str(folder), store + "-twice"))["a"][:4] == (5, 0, 1, 9)
    (folder / "two.parquet").unlink()
    assert exact(states.refresh(spark, str(folder), store))["a"][:4] == (2, 0, 1, 2)


def test_many_files_take_few_jobs(spark, tmp_path):
    spark.range(600).select("id", (F.col("id") % 7).alias("k")).repartition(60, "id").write.option("maxRecordsPerFile", 5).parquet(str(tmp_path / "rows"))
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in range(2):
        spark.sparkContext.setJobGroup(f"many-{n}", "")
        assert exact(states.refresh(spark, str(tmp_path / "rows"), str(tmp_path / "store")))["id"][:4] == (600, 0, 0, 599)
        counts.append(len(tracker.getJobIdsForGroup(f"many-{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert spark.read.parquet(str(tmp_path / "store")).select("file").distinct().count() > 100
    assert max(counts) < 30
