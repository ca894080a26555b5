"""The pipeline's stages against what each operator says by itself."""

import edge
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("tables")
    q = edge.prose(2000, 30)
    rows = [(i, edge.prose(1000 + i, 120), "en", f"s{i % 3}") for i in range(30)]
    rows += [(40, edge.BASE, "en", "s0"), (41, edge.BASE, "en", "s0"), (42, edge.edited(edge.BASE, 2, 0.01).replace("\n", " "), "en", "s1"), (50, edge.prose(60, 80) + " " + q, "en", "s1"), (60, edge.prose(61, 100).upper().replace(" ", "!! "), "en", "s2"), (61, "", "en", "s2"), (62, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{p}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(60, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{p}/labels.parquet")
    spark.createDataFrame([(1, q)], "item_id long, text string").write.parquet(f"{p}/benchmark.parquet")
    return str(p)


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "curriculum_mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(30))
    assert all(clean <= k for k in kept)
    assert not kept[0] & {60, 61, 62}
    assert 41 not in kept[1] and {40, 42, 50} <= kept[1]
    assert 42 not in kept[2] and 40 in kept[2]
    assert kept[3] == clean | {40}


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(range(30)) | {40}
    assert {"taken", "position", "target"} <= set(rows[0].asDict())


def tables(spark, p, docs, schema, labels=(), items=()):
    spark.createDataFrame(docs, schema).write.parquet(f"{p}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{p}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{p}/benchmark.parquet")
    return str(p)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept int, n_words string, n_removed string, spans string, n_hit int, node int, component_id int, _gone int"


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], CLASHING)).count() == 0


def test_nulls_and_clashing_names(spark, tmp_path):
    good = [(i, edge.prose(3000 + i, 100)) for i in range(8)]
    rows = [*good, (None, edge.prose(3100, 100)), (20, None), (21, ""), (22, edge.prose(3200, 9000))]
    docs = [(d, t, None, None if (d or 0) % 2 else "s", None, 0, "w", "r", "p", 7, 8, 9, 10) for d, t in rows]
    folder = tables(spark, tmp_path, docs, CLASHING, [(None, None, None), (1, None, 1)], [(None, None), (1, "")])
    frame, names = spark.read.parquet(f"{folder}/documents.parquet"), CLASHING.split(", ")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder).persist()
        assert frame.columns == [x.split()[0] for x in names]
        assert {tuple(r)[5:] for r in frame.collect()} == {(0, "w", "r", "p", 7, 8, 9, 10)}
        assert sorted(str(r.doc_id) for r in frame.collect()) == sorted(str(d) for d, t in rows if t)
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == 10 and {"taken", "position", "lang", "n_hit"} <= set(out[0].asDict())


def test_near_stage_judges_rows_by_their_own_texts(spark, tmp_path):
    one, two = edge.prose(4000, 120), edge.prose(4001, 120)
    rows = [(5, one), (5, two), (5, two), (3, one), (None, two), (None, edge.prose(4002, 120)), (None, edge.prose(4003, 120)), (None, ""), (None, ""), (7, None), (8, edge.edited(two, 3, 0.01))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect()]
    want = [(3, one), (5, two), (None, edge.prose(4002, 120)), (None, edge.prose(4003, 120)), (None, ""), (None, ""), (7, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
