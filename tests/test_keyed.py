"""sqlite tables by key ranges against the rows that were written."""

import random
import sqlite3

import pytest

from siftwell.sources import keyed, ranges, readers


def write(path, table, columns, rows, extra=""):
    con = sqlite3.connect(path)
    con.execute(f"CREATE TABLE {table} ({columns}){extra}")
    con.executemany(f"INSERT INTO {table} VALUES ({','.join('?' * len(columns.split(',')))})", rows)
    con.commit()
    con.close()


@pytest.mark.parametrize("rows,step", [(1, 4096), (7, 5000), (100, 1 << 26)])
def test_keys_of_any_spread_give_even_pieces(spark, tmp_path, rows, step):
    rng = random.Random(rows)
    keys = sorted({*range(40), *(2**40 + rng.randrange(60) for _ in range(40)), -(2**63), 2**63 - 1})
    write(tmp_path / "a.db", "t", "k INTEGER PRIMARY KEY, v TEXT", [(k, f"v{k}") for k in keys])
    files = ranges.list_files(spark, str(tmp_path))
    found = keyed.saved(spark, files, rows=rows, step=step)
    assert sum(r.n_rows for r in found.collect()) == len(keys) and max(r.n_rows for r in found.collect()) <= rows
    assert found.count() >= len(keys) / rows
    df = keyed.rows_of(found, batch_rows=3)
    assert sorted((r.k, r.v) for r in df.collect()) == [(k, f"v{k}") for k in keys]
    assert df.rdd.getNumPartitions() > 1 or rows == 100


def test_types_are_merged_over_pieces_and_files(spark, tmp_path):
    write(tmp_path / "a.db", "t", "whole, number, mixed, bytes, none", [(i, i, i, None, None) for i in range(10)] + [(1, 0.5, "x", b"\x01\xff", None)] * 2)
    write(tmp_path / "b.db", "t", "NUMBER, whole, more", [(1.5, None, "é" * 100_000)])
    df = keyed.read_sqlite(spark, ranges.list_files(spark, str(tmp_path)), rows=4)
    kinds = {f.name.lower(): f.dataType.simpleString() for f in df.schema}
    assert kinds == {"whole": "bigint", "number": "double", "mixed": "string", "bytes": "string", "none": "string", "more": "string"}
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == 13 and sum(r["mixed"] == "x" and r["bytes"] == "01ff" for r in rows) == 2
    assert [len(r["more"]) for r in rows if r["more"]] == [100_000] and sum(r["NUMBER"] for r in rows) == 45 + 1 + 1.5


def test_tables_without_keys_hidden_keys_and_empty_ones(spark, tmp_path):
    write(tmp_path / "a.db", "keyless", "k INTEGER PRIMARY KEY, v", [(1, "x"), (2, None)], " WITHOUT ROWID")
    write(tmp_path / "a.db", "hidden", "rowid, oid, _rowid_", [(1, 1, 1)] * 9)
    write(tmp_path / "a.db", '"od""d, name"', "rowid TEXT, v", [("same", i) for i in range(9)])
    write(tmp_path / "a.db", "bare", "v", [])
    files = ranges.list_files(spark, str(tmp_path))
    counts = {r.name: (r.n_rows, r.n_pieces) for r in keyed.table_counts(spark, files, rows=4).collect()}
    assert counts == {"keyless": (2, 1), "hidden": (9, 1), 'od"d, name': (9, 3)}
    assert [r.v for r in keyed.read_sqlite(spark, files, 'od"d, name', rows=4).orderBy("v").collect()] == list(range(9))
    assert keyed.read_sqlite(spark, files, "bare") is None and keyed.read_sqlite(spark, files, "no such table") is None


def test_reader_takes_the_first_table(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY AUTOINCREMENT, v)")
    con.executemany("INSERT INTO t (v) VALUES (?)", [(i,) for i in range(5)])
    con.execute("CREATE INDEX i ON t (v)")
    con.execute("ANALYZE")
    con.commit()
    con.close()
    df = readers.read_table(spark, str(tmp_path / "a.db"), "sqlite")
    assert df.columns == ["k", "v"] and [tuple(r) for r in df.orderBy("k").collect()] == [(i + 1, i) for i in range(5)]
