"""Files by byte ranges: detection of huge files, and tables cut at any place."""

import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell.context import Options
from siftwell.plans.inspect import inspect
from siftwell.sources import readers, split
from siftwell.sources.detect import detect, detect_files
from siftwell.sources.ranges import Ranged, by_range, list_files

SNIFF = 256 * 1024


def lines_of_json(size):
    out, i = [], 0
    while sum(map(len, out)) + len(out) < size:
        out.append(json.dumps({"id": i, "text": "words " * (i % 40)}))
        i += 1
    return "\n".join(out).encode()


@pytest.mark.parametrize("size", [SNIFF - 5000, SNIFF + 5000, 3 * SNIFF])
def test_json_lines_in_a_json_file_of_any_size(spark, tmp_path, size):
    data = lines_of_json(size)
    (tmp_path / "rows.json").write_bytes(data)
    assert detect("rows.json", data[:SNIFF], len(data) <= SNIFF).file_type == "jsonl"
    (report,) = inspect(spark, str(tmp_path / "rows.json"), Options())
    assert report.file_type == "jsonl" and report.profile["rows_profiled"] == data.count(b"\n") + 1


@pytest.mark.parametrize("indent", [None, 2])
def test_a_cut_json_value_is_json(indent):
    data = json.dumps([{"id": i, "text": "x" * 100} for i in range(4000)], indent=indent).encode()
    assert len(data) > SNIFF and detect("a.json", data[:SNIFF], False).file_type == "json"


def test_huge_files_are_told_by_their_ends(spark, tmp_path):
    with (tmp_path / "hole.bin").open("wb") as f:
        f.write(b"\x00\x01" * 100)
        f.truncate(5 << 30)
    with (tmp_path / "rows.csv").open("wb") as f:
        f.write(b"a,b,c\n" + b"1,2,3\n" * 60_000)
        f.truncate(5 << 30)
    with zipfile.ZipFile(tmp_path / "arrays.bin", "w") as z:
        for i in range(30):
            z.writestr(f"a{i}.npy", bytes(10**6))
    got = {r.path.rsplit("/", 1)[-1]: r for r in detect_files(spark, str(tmp_path)).collect()}
    assert {n: r.file_type for n, r in got.items()} == {"hole.bin": "binary", "rows.csv": "csv", "arrays.bin": "npz"}
    assert got["hole.bin"].length == got["rows.csv"].length == 5 << 30
    assert all(r.n_read < 10**6 for r in got.values())


# --- CSV


def quoted_file(seed, rows=40, delimiter=","):
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choice(["a", "bc", " ", "é", '""', "\n", delimiter, "\n\n", "x" * 9]) for _ in range(rng.randrange(6)))
    out = [delimiter.join(["k", '"a ""name"""', "v", "w"])]
    for i in range(rows):
        cells = [str(i), f'"{pick()}"', rng.choice(["", "plain text", '""', 'in "side" it', f'"{pick()}"']), str(i / 4)]
        out.append(delimiter.join(cells[: 4 if rng.random() < 0.9 else 3]))
    end = rng.choice(["\n", "\r\n"])
    return end.join(out) + rng.choice(["", end, end + end])


def cut_records(data, step, delimiter=","):
    """Records by composing states over ranges, as the two passes do."""
    made, file, state, out = split.Csv(delimiter), Ranged("", data), split.RECORD, []
    for start in range(0, len(data), step):
        part = data[start : start + step]
        out += made.records(file, start, start + len(part), state, 5)
        state = made.ends(part)[state]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_records_cut_at_every_step(seed):
    delimiter = ",;|\t"[seed % 4]
    data = quoted_file(seed, 12, delimiter).encode()
    whole = cut_records(data, len(data), delimiter)
    rows = [r for r in csv.reader(io.StringIO(data.decode(), newline=""), delimiter=delimiter) if r]
    assert [next(csv.reader(io.StringIO(v.decode(), newline=""), delimiter=delimiter)) for _, v in whole if v.strip(b"\r")] == rows
    for step in range(1, len(data)):
        assert cut_records(data, step, delimiter) == whole, step


@pytest.mark.parametrize(("seed", "step"), [(1, 7), (2, 50), (3, 1000), (4, 10**6), (5, 33)])
def test_split_csv_equals_the_reader_of_whole_files(spark, tmp_path, seed, step):
    (tmp_path / "a.csv").write_text(quoted_file(seed), newline="")
    options = readers.csv_options({}, "csv")
    want = spark.read.options(**options, multiLine="true").csv(str(tmp_path / "a.csv"))
    got = split.read_csv(spark, list_files(spark, str(tmp_path / "a.csv")), options, step=step)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_mark_before_a_quoted_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"id","no\nte"\n1,"x\ny"\n2,é\n'.encode("utf-8-sig"))
    options = readers.csv_options({}, "csv")
    for step in (2, 5, 1000):
        got = split.read_csv(spark, list_files(spark, str(tmp_path / "a.csv")), options, step=step)
        assert got.columns == ["id", "no\nte"] and sorted(map(tuple, got.collect())) == [(1, "x\ny"), (2, "é")]


def test_quotes_beyond_the_sniffed_part_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n" + "1,plain\n" * 40_000 + '2,"two\nlines"\n')
    (report,) = inspect(spark, str(tmp_path / "a.csv"), Options())
    assert report.profile["rows_profiled"] == 40_001


def test_ranges_are_dealt_over_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 1000)
    cuts = by_range(list_files(spark, str(tmp_path / "a.csv")), 10)
    assert cuts.count() == 100 and cuts.select(F.spark_partition_id()).distinct().count() > 8


# --- JSON


def json_file(seed, indent=None):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(["a", '"', "\\", "{", "}", "[", "]", "\\\\", "é", "\n"]) for _ in range(rng.randrange(8)))
    rows = [{"id": i, text() or "k": text(), "deep": {"list": [text(), {"x": [i]}], "none": None}} for i in range(12)]
    return json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5)


def cut_objects(data, step):
    file, state, out = Ranged("", data), split.OUT, []
    for start in range(0, len(data), step):
        part = data[start : start + step]
        out += split.json_objects(file, start, start + len(part), state, 5)
        state = state - state % 3 + split.json_ends(part)[state % 3]
    return out, state


@pytest.mark.parametrize("seed", range(6))
def test_objects_cut_at_every_step(seed):
    text = json_file(seed, 1 if seed % 2 else None)
    data, want = text.encode(), json.loads(text)
    for step in range(1, len(data)):
        got, state = cut_objects(data, step)
        assert state == split.OUT and [json.loads(v) for at, v in got if at >= 0] == want and len(got) == len(want), step


@pytest.mark.parametrize("text", ['[1, {"a": 1}]', '[{"a": 1}, "x"]', '[[{"a": 1}]]', '{"a": [{"b": 1}]}', '[{"a": 1', "[]"])
def test_lists_of_anything_else_are_no_table(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    for step in (3, 1000):
        assert split.read_json(spark, list_files(spark, str(tmp_path / "a.json")), step) is None


def test_split_json_is_the_table(spark, tmp_path):
    rows = [{"id": i, "text": "x" * (i % 300), "in": {"a": [i]}} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = split.read_json(spark, list_files(spark, str(tmp_path / "a.json")), 1000)
    assert [(r.id, r.text, r["in"].a) for r in got.orderBy("id").collect()] == [(r["id"], r["text"], r["in"]["a"]) for r in rows]


# --- archives


def test_members_spread_over_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(10_000):
            z.writestr(f"in/{i}.csv", f"id,v\n{i},{i % 7}\n{-i},1\n")
        z.writestr("stored.jsonl", "\n".join(json.dumps({"id": i}) for i in range(5)), zipfile.ZIP_STORED)
        z.writestr("notes.txt", "plain words\nmore words\n")
    entries = readers.zip_entries(spark, str(tmp_path / "many.zip"))
    assert entries.count() == 10_002
    rows = readers.entry_rows(entries).withColumn("task", F.spark_partition_id())
    one = rows.groupBy().agg(F.count("*").alias("n"), F.countDistinct("member").alias("members"), F.countDistinct("task").alias("tasks"), F.sum(F.get_json_object("value", "$.id").cast("long")).alias("ids")).first()
    assert (one.n, one.members, one.ids) == (20_005, 10_001, 10) and one.tasks > 8


def test_a_member_larger_than_the_steps_is_streamed(spark, tmp_path):
    text = "id,note\n" + "".join(f"{i},{'x' * 50}\n" for i in range(20_000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.txt", "words only\nand words\n")
        z.writestr("a.csv", text)
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        e = z.getinfo("a.csv")
        want = z.read(e)
    got = readers.Inflated(str(tmp_path / "a.zip"), e.header_offset, e.compress_size, e.compress_type, e.CRC, step=1000)
    assert io.BufferedReader(got).read() == want
    name, df = readers.container_table(spark, str(tmp_path / "a.zip"), 1000)
    assert name.endswith("a.csv") and df.count() == 20_000


def test_a_broken_member_gives_a_row_without_value(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good.csv", "a,b\n1,2\n3,4\n")
        z.writestr("bad.csv", "a,b\n5,6\n7,8\n")
    data = (tmp_path / "a.zip").read_bytes().replace(b"5,6", b"5,9", 1)
    (tmp_path / "a.zip").write_bytes(data)
    got = readers.entry_rows(readers.zip_entries(spark, str(tmp_path / "a.zip"))).collect()
    assert sum(r.value is None for r in got) == 1 and sum(r.member == "good.csv" for r in got) == 2


def test_small_ranges_share_tasks_and_read_little(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text("[" + ", ".join(json.dumps({"id": i, "note": 'a "]\\ b'}) for i in range(40000)) + "]")
    size = path.stat().st_size
    files = spark.createDataFrame([(str(path), size)], "path string, length long")
    held = by_range(files, 1009).select("start", "stop", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.start, r.stop) for r in held) == [(a, min(a + 1009, size)) for a in range(0, size, 1009)]
    tasks = [r.task for r in sorted(held)]
    assert len(set(tasks)) > 8 and sum(a != b for a, b in zip(tasks, tasks[1:], strict=False)) < len(tasks) / 10
    with Ranged(str(path)) as file:
        rows = list(split.json_objects(file, 0, 1009, split.OUT))
        assert len(rows) > 20 and file.n_read < 10_000
    for data in (b'"', b'\\"]', b'a"{\\', b'"\\\\"[', b"]}"):
        wants = [split.signs(data, s) for s in range(3)]
        assert split.json_ends(data) == [3 * int(add.sum()) + end for _, add, _, end in wants]


def test_lines_are_written_by_every_part_of_the_table(spark, tmp_path, monkeypatch):
    from siftwell.plans import file_queries

    for i in range(4):
        spark.range(5 * i, 5 * i + 5).selectExpr("id AS l_orderkey").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(file_queries.scratch, "new_folder", lambda s: f"file://{tmp_path}/out")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        row = file_queries.json_lines_by_range(spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert (row.n_rows, row["keys"], row.read_in_part) == (20, 190, True)
    assert len(list((tmp_path / "out" / "lines").glob("*.json"))) == 4
