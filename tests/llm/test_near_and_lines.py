import itertools
import random

import edge
import numpy as np
import pytest

from siftwell.llm import line_dedup, minhash_near_dedup, shingles
from siftwell.llm.common import Shared


def shingle_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {d: shingle_words(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


@pytest.mark.parametrize("block", [2048, 2])
def test_components(spark, shared, monkeypatch, block):
    monkeypatch.setattr(minhash_near_dedup, "BLOCK", block)
    rows = [(d, t) for d, t, _ in edge.texts() if d is not None]
    base = edge.prose(77, 150)
    rows += [(100 + i, edge.edited(base, i, 0.02)) for i in range(25)] + [(130, base), (131, base.upper())]
    # a chain: each is near the next only
    chain = edge.prose(78, 200)
    for i in range(6):
        rows.append((140 + i, chain))
        chain = edge.edited(chain, 200 + i, 0.02)
    rows += [(160 + i, edge.edited(base, 300 + i, 0.05)) for i in range(15)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shared).collect()}
    assert got == brute_components(dict(rows).items())


def test_rows_of_one_id_with_other_texts_belong_together(spark, shared):
    a, b = edge.prose(901, 80), edge.prose(902, 80)
    rows = [(3, a), (3, b), (3, b), (5, a), (7, b), (8, edge.prose(903, 80))]
    got = minhash_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shared).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True)] * 3 + [(5, 3, False), (7, 3, False), (8, 8, True)]


def test_links_without_a_common_centre(spark, shared, monkeypatch):
    # no star is confirmed: bands with partners and full sets must find every link, in blocks and by rare shingles too
    base = edge.prose(77, 150)
    rows = [(100 + i, edge.edited(base, i, 0.03)) for i in range(40)] + [(i, edge.prose(500 + i, 60)) for i in range(10)]
    confirmed = minhash_near_dedup.confirmed
    monkeypatch.setattr(minhash_near_dedup, "confirmed", lambda pairs, texts: confirmed(pairs, texts).where("false"))
    for block in (2048, 4):
        monkeypatch.setattr(minhash_near_dedup, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Shared(spark)).collect()}
        assert got == brute_components(rows)


def test_null_id_links_with_nothing(spark, shared):
    rows = [(None, edge.BASE), (5, edge.BASE), (6, edge.BASE)]
    got = minhash_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shared).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("6", "5", False), ("None", "None", True)]


def test_estimates_and_sql_form(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows, want = [], []
    for share in (0.5, 0.75, 0.9, 1.0):
        both, own = rng.integers(0, 1 << 63, int(600 * share), np.uint64), rng.integers(0, 1 << 63, (2, 600 - int(600 * share)), np.uint64)
        a, b = (np.unique(np.concatenate([both, x])) for x in own)
        pa_, pb = (minhash_near_dedup.packed(minhash_near_dedup.minima(x)) for x in (a, b))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = minhash_near_dedup.estimate(minhash_near_dedup.agreeing(pa_.view(np.uint64), pb.view(np.uint64)))
        assert abs(est - j) < 0.14
        rows.append((pa_.tolist(), pb.tolist()))
        want.append(est)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert [r[0] for r in df.select(minhash_near_dedup.sql_estimate(F.col("a"), F.col("b"))).collect()] == pytest.approx(want)


def test_shingles_are_exact():
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.choice(["a", "b", "Ab", "ü"]) for _ in range(rng.randint(0, 30))]
        text = rng.choice([" ", "\n", "  "]).join(words)
        assert len(shingles.shingle_set(text.encode())) == len(shingle_words(text))


def brute_lines(rows):
    seen, out = set(), {}
    for d, t in rows:
        parts = (t or "").split("\n")
        solid = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(parts) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(solid) - 2):
            window = tuple(x for _, x in solid[k : k + 3])
            if window in seen:
                gone.update(range(k, k + 3))
            seen.add(window)
        lines = set()
        for k in gone:
            lines.add(solid[k][0])
            if k + 1 in gone:
                lines.update(range(solid[k][0], solid[k + 1][0]))
        out[d] = (len(lines), "\n".join(x for i, x in enumerate(parts) if i not in lines))
    return out


def test_lines(spark, shared):
    block = "first line\n\n second line \nthird line\nfourth line"
    rows = [(1, "head\n" + block + "\ntail"), (2, block), (3, "second line\nthird line\nfourth line\nown"), (4, "first line\nsecond line"), (5, (block + "\n") * 3), (6, None), (7, ""), (8, "a\nb\nc\na\nb\nc\nd"), (9, "\n\n\n")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), shared).collect()}
    assert got == brute_lines(rows)


def test_lines_sql(spark, duck):
    from compare import SMALL, same

    from siftwell.llm import queries

    for name in ("op5_line_dedup", "op8_curriculum_mixing", "op6_benchmark_decontamination", "op1_chat_formatting", "quality_base", "length_sums"):
        same(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])
