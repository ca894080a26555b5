"""Merged types of records against a walk in one process, and tables read by them."""

import json
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators import lattice

TEXTS = [
    None, "", "{", "NaN", "[NaN]", "null", "3", '"x"', "[]", "{}", '{"a": 1}', '{"a": 1.5, "b": null}', '{"a": null, "b": [1, [true, {"c d": "é"}]]}', '{"b": {"a": 1}}', '{"a": 99999999999999999999}',
    '{"a": 1, "a": "last"}', '{"x.y": {"it\'s": [1, "2"]}}', "[" * 100_000, json.dumps({"long": "z" * 300_000}), '{"a": 1}', '{"a": 1}',
]


def brute(texts):
    found = defaultdict(list)
    for t in texts:
        for path, _, _, kind, size in lattice.walk(t):
            found[path, kind].append(size)
    return {k: (len(v), min(v), max(v), sum(v)) for k, v in found.items()}


def told(df):
    return {(r.path, r.kind): (r.n, r.low_size, r.high_size, r.sum_size) for r in df.collect()}


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(str(i % 2), t) for i, t in enumerate(texts)], "file string, text string").repartition(parts)


def test_states_equal_a_walk_and_add_up(spark):
    df = frame(spark, TEXTS)
    assert told(lattice.states(df, "text")) == brute(TEXTS)
    parts = lattice.states(df, "text", ["file"])
    assert told(lattice.merged(parts)) == brute(TEXTS)
    assert told(parts.where("file = '1'")) == brute(TEXTS[1::2])
    assert lattice.states(df.limit(0), "text").count() == 0
    # what follows from states reads them, not the records
    assert "MapInArrow" not in lattice.nodes(parts, ["file"])._jdf.queryExecution().toString()


def test_fixed_expectations(spark):
    texts = ['{"a": 1, "b": [1, "x"]}', '{"a": 2.5}', '{"b": null, "x y": {}}', "no json", None]
    rows = {r.path: r for r in lattice.nodes(lattice.states(frame(spark, texts), "text")).collect()}
    assert {p: r.type for p, r in rows.items()} == {"$": "object", "$.a": "double", "$.b": "array", "$.b[]": "mixed", "$['x y']": "object"}
    assert (rows["$.a"].n_missing, rows["$.b"].n_missing, rows["$.b"].n_null, rows["$"].n, rows["$"].n_missing) == (1, 1, 1, 5, None)
    assert rows["$"].kinds == ["absent", "malformed", "object"] and rows["$.b[]"].kinds == ["long", "string"]


def test_many_paths_pass_in_parts(spark, monkeypatch):
    texts = [json.dumps({f"k{i}": i, "same": i}) for i in range(50)]
    monkeypatch.setattr(lattice, "HELD", 7)
    assert told(lattice.states(frame(spark, texts), "text")) == brute(texts)
    try:
        lattice.schema_of(lattice.nodes(lattice.states(frame(spark, texts), "text")), most=20)
        raise AssertionError("a schema of data-like keys was made")
    except ValueError as e:
        assert "paths" in str(e)


def test_table_of_records(spark):
    texts = ['{"a": 1, "m": 1, "o": {"i": [1, 2.5]}}', '{"a": null, "m": {"z": [true]}, "o": {}}', '{"a": 3}', "[1]", "{broken", None]
    df = lattice.table_of(frame(spark, texts), "text", ["file"])
    assert dict(df.dtypes) == {"file": "string", "a": "bigint", "m": "string", "o": "struct<i:array<double>>"}
    rows = {r.a: r for r in df.collect()}
    assert len(rows) == 3 and rows[1].o.i == [1.0, 2.5] and rows[1].m == "1" and json.loads(rows[None].m) == {"z": [True]} and rows[3].o is None
    assert lattice.table_of(frame(spark, ["[1]", "x"]), "text") is None


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab .", max_size=2), x, max_size=3), max_leaves=8)


@given(st.lists(values, max_size=4), st.lists(values, max_size=4))
@settings(max_examples=60, deadline=None)
def test_walk_is_whole(left, right):
    """Every value of a record is met once, and counts of two lists add up."""

    def size(v):
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return 1 + sum(map(size, inner))

    for v in left + right:
        assert len(lattice.walk(json.dumps(v))) == size(v)
    a, b, both = (brute([json.dumps(v) for v in x]) for x in (left, right, left + right))
    for k, (n, low, high, total) in both.items():
        ends = [x[k] for x in (a, b) if k in x]
        assert (n, low, high, total) == (sum(e[0] for e in ends), min(e[1] for e in ends), max(e[2] for e in ends), sum(e[3] for e in ends))
