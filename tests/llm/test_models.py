import itertools
import math
from collections import Counter

import edge
import numpy as np
import pytest

from siftwell.llm import lm_scoring, quality_classifier, quality_rules, text_stats
from siftwell.llm.common import py_crc_bucket

FIELD = quality_rules.Field(turns=((0.7, -0.4), (-0.2, 0.3)), start=0.3)


def path_score(labels, scores, field):
    total = sum(s for s, b in zip(scores, labels, strict=True) if b) + (field.start if labels[0] else 0)
    return total + sum(field.turns[a][b] for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(40):
        scores = rng.normal(size=rng.integers(1, 8)).tolist()
        got = quality_rules.viterbi(scores, FIELD)
        best = max(path_score(p, scores, FIELD) for p in itertools.product((0, 1), repeat=len(scores)))
        assert path_score(got, scores, FIELD) == pytest.approx(best)


def test_likelihood_and_gradient():
    rng = np.random.default_rng(3)
    k = len(quality_rules.SIGNS)
    docs = [(rng.integers(0, 2, (n, k)).astype(float), rng.normal(size=n)) for n in (2, 4, 1)]
    lines, theta = quality_rules.Lines.of(docs), rng.normal(size=k + 5)
    value, grad = quality_rules.likelihood(lines, theta, 0.01, 0.02)
    field = quality_rules.Field(tuple(theta[:k]), (tuple(theta[k : k + 2]), tuple(theta[k + 2 : k + 4])), theta[k + 4])
    want = 0.0
    for x, e in docs:
        scores, paths = (x @ theta[:k]).tolist(), list(itertools.product((0, 1), repeat=len(x)))
        free = np.logaddexp.reduce([path_score(p, scores, field) for p in paths])
        held = np.logaddexp.reduce([path_score(p, scores, field) + np.dot(p, e) for p in paths])
        want += (held - free) / 3
    assert value == pytest.approx(want - 0.01 * (theta**2).sum() - 0.01 * (theta[k : k + 4] ** 2).sum())
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        slope = (quality_rules.likelihood(lines, theta + step, 0.01, 0.02)[0] - quality_rules.likelihood(lines, theta - step, 0.01, 0.02)[0]) / 2e-5
        assert grad[i] == pytest.approx(slope, abs=1e-6)


def test_boilerplate_around_prose_is_labelled_line_by_line(spark):
    junk = lambda i: edge.prose(i, 36).upper().replace(" ", "!! ")
    notice = "Licensed under the Some License, see http://example.org"
    good = [(i, edge.prose(i, 120) + ("\n" + notice if i % 3 == 0 else "")) for i in range(60)]
    bad = [(100 + i, edge.prose(300 + i, 12) + "\n" + junk(i) + "\n" + junk(50 + i)) for i in range(40)]
    around = (900, junk(800) + "\n" + edge.prose(801, 144) + "\n" + notice)
    docs = spark.createDataFrame([*good, *bad, around], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1) for d, _ in good[:40]] + [(d, 0) for d, _ in bad[:30]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    assert got[900].line_labels == "b" * 3 + "c" * 12 + "b" and got[900].kept
    assert all(got[d].kept and got[d].line_labels.endswith("cb" if d % 3 == 0 else "cc") for d, _ in good)
    assert not any(got[d].kept for d, _ in bad)


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_counts():
    for t in [t for _, t, _ in edge.texts()] + ["a b a b a b", "x\nx\n x\n\n\n", "|#| <a> &"]:
        assert text_stats.base_counts((t or "").encode())[:5] == brute_counts(t)


def test_rules_keep_prose_and_reject_junk(spark):
    good = [(i, edge.prose(i, 120)) for i in range(60)]
    junk = [(100 + i, edge.prose(i, 120).upper().replace(" ", "!! ")) for i in range(20)] + [(130 + i, edge.prose(i, 100).replace(" ", "$$$ ")) for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1) for d, _ in good[:30]] + [(d, 0) for d, _ in junk[::2]], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    assert all(kept[d] for d, _ in good) and not any(kept[d] for d, _ in junk)


def test_forward_equals_enumeration():
    rng = np.random.default_rng(1)
    m = lm_scoring.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T)
    texts = [np.array(x) for x in ([0, 1, 2, 3], [3], [1, 1, 0])]
    for group in lm_scoring.batches_of(texts):
        obs, alive = lm_scoring.padded(texts, group)
        got = lm_scoring.forward(m, m.emit[obs], alive)[0]
        for i, g in zip(group, got, strict=True):
            t = texts[i]
            p = sum(m.start[s[0]] * math.prod(m.turn[a, b] for a, b in zip(s, s[1:], strict=False)) * math.prod(m.emit[o, x] for o, x in zip(t, s, strict=True)) for s in itertools.product(range(3), repeat=len(t)))
            assert g == pytest.approx(math.log(p))


def test_baum_welch_never_loses_likelihood():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 6, rng.integers(3, 40)) for _ in range(30)]
    counts = lm_scoring.empty(6)
    m = lm_scoring.Model(np.full(lm_scoring.STATES, 1 / lm_scoring.STATES), rng.dirichlet(np.ones(lm_scoring.STATES), lm_scoring.STATES), rng.dirichlet(np.ones(6), lm_scoring.STATES).T)
    last = -np.inf
    for _ in range(5):
        counts = lm_scoring.empty(6)
        now = lm_scoring.expected(m, texts, counts)
        assert counts.emit.sum() == pytest.approx(sum(map(len, texts))) and counts.start.sum() == pytest.approx(len(texts))
        assert now >= last - 1e-3
        last = now
        m = lm_scoring.Model(counts.start / counts.start.sum(), counts.turn / counts.turn.sum(1, keepdims=True), counts.emit / counts.emit.sum(0))


def test_long_texts_in_stretches(monkeypatch):
    rng = np.random.default_rng(8)
    s = lm_scoring.STATES
    m = lm_scoring.Model(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(9), s).T)
    texts = [rng.integers(0, 9, n).astype(np.uint16) for n in (300, 280, 151, 150, 29, 7, 1)]
    got = []
    for places in (1 << 19, 50):
        monkeypatch.setattr(lm_scoring, "PLACES", places)
        counts = lm_scoring.empty(9)
        monkeypatch.setattr(lm_scoring, "batches_of", lambda x: [list(range(len(x)))])
        total = lm_scoring.expected(m, texts, counts)
        exact = lm_scoring.likelihoods(m, *lm_scoring.padded(texts, list(range(len(texts)))))[0]
        assert exact.sum() == pytest.approx(total, rel=1e-5)
        got.append((total, counts))
    assert got[0][0] == pytest.approx(got[1][0], rel=1e-6)
    for name in ("start", "turn", "emit"):
        assert np.allclose(getattr(got[0][1], name), getattr(got[1][1], name), rtol=1e-3, atol=1e-4)
    assert got[1][1].emit.sum() == pytest.approx(sum(map(len, texts)), rel=1e-4) and got[1][1].turn.sum() == pytest.approx(sum(len(t) - 1 for t in texts), rel=1e-4)


def test_lm_base_score_and_gain(spark, shared):
    # two tongues: a model of states tells them apart, word counts don't
    rows = [(i, edge.prose(i, 150) if i % 2 else " ".join(w + "on" for w in edge.prose(i, 150).split())) for i in range(240)] + [(300, None), (301, ""), (302, "unseenword " * 3)]
    got = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), shared, rounds=1).collect()}
    tokens = {d: [*(t or "").encode().lower().split(), 0] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if py_crc_bucket(d, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (py_crc_bucket(d, 5) == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [d for d, _ in rows[:240] if got[d].held_out]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(5)
    level, count = np.arange(12.0), rng.integers(1, 5, 12).astype(float)
    ones = np.array([rng.integers(0, c + 1) for c in count], float)
    knots, values = quality_classifier.isotonic(level, ones, count)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    # the pooled means: min over ends of max over begins
    mean = lambda a, b: ones[a : b + 1].sum() / count[a : b + 1].sum()
    fit = [min(max(mean(a, b) for a in range(i + 1)) for b in range(i, 12)) for i in range(12)]
    assert len({round(f, 9) for f in fit}) == len(knots)


def test_classifier_on_held_out(spark, shared):
    rows = [(i, edge.prose(i, 90) if i % 2 else edge.prose(i, 90).upper().replace(" ", "!! ")) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels, shared).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 50 and all(r.predicted == r.doc_id % 2 for r in held)


def test_states_are_fitted_to_long_texts(spark, shared, monkeypatch):
    # long texts in two tongues: the states must part them, and the last round over all texts must gain next to nothing
    rows = [(i, edge.prose(i, 5200) if i % 2 else " ".join(w + "on" for w in edge.prose(i, 5200).split())) for i in range(24)]
    models, round_ = [], lm_scoring.baum_welch_round

    def kept(*given):
        models.append(round_(*given))
        return models[-1]

    monkeypatch.setattr(lm_scoring, "baum_welch_round", kept)
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), shared).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.score > r.base_score + 0.2 * r.n_tokens for r in held)
    (model, now), (_, before) = models[-1], models[-2]
    assert 0 <= now - before <= lm_scoring.SETTLED * got[0].train_tokens
    assert (model.emit[1:9].std(1) > 0.5 * model.emit[1:9].mean(1)).all()


def test_frequent_words_are_exact_however_texts_are_dealt(spark):
    # most words stand in every task; 40 more, last by name, in one only, but oftener
    common = [f"a{i}" for i in range(20_000)]
    hot = [f"z{i}" for i in range(40)]
    texts = [" ".join(common[i::2]) for i in (0, 1)] * 8 + [" ".join(hot * 20)]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    exact = Counter(w for t in texts for w in t.encode().split())
    want = sorted(exact.items(), key=lambda x: (-x[1], x[0]))[: lm_scoring.HEAD]
    for parts in (1, 3, len(texts)):
        assert lm_scoring.frequent_words(lm_scoring.word_counts(docs.repartition(parts))) == want
    assert {w.encode() for w in hot} <= {w for w, _ in want}


def test_scores_equal_enumeration_over_states(spark, shared, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 3)
    monkeypatch.setattr(lm_scoring, "frequent_words", lambda counts, most=3, f=lm_scoring.frequent_words: f(counts, most))
    rng, held = np.random.default_rng(6), {}

    def random_model(coded, model, tokens, rounds=None):
        held["m"] = lm_scoring.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(len(model.emit)), 8).T)
        return held["m"]

    monkeypatch.setattr(lm_scoring, "baum_welch", random_model)
    rows = [(i, t) for i, t in enumerate(["a b", "a b c", "A c", "rare a", "b rare", "other b", "a", "", None, "never seen", "a rare other"] * 2)]
    got = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), shared).collect()}
    tokens = {d: (t or "").encode().lower().split() for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if py_crc_bucket(d, 5) != 1 for w in ws)
    head = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]]
    rest = {w: c for w, c in counts.items() if w not in head}
    number = lambda w: head.index(w) + 1 if w in head else len(head) + 1 + lm_scoring.shape(w)
    m = held["m"]
    for d, ws in tokens.items():
        obs, inside = [*map(number, ws), lm_scoring.END], 0.0
        for w in ws:
            if w not in head:
                own = [c for v, c in rest.items() if lm_scoring.shape(v) == lm_scoring.shape(w)]
                inside += math.log10((rest.get(w, 0) + 0.5) / (sum(own) + 0.5 * (len(own) + 1)))
        p = sum(m.start[s[0]] * math.prod(m.turn[a, b] for a, b in zip(s, s[1:], strict=False)) * math.prod(m.emit[o, x] for o, x in zip(obs, s, strict=True)) for s in itertools.product(range(8), repeat=len(obs)))
        assert got[d].score == pytest.approx(math.log10(p) + inside), d


def test_scores_do_not_depend_on_partitions(spark, shared):
    from siftwell.llm.common import Shared

    rows = [(i, edge.prose(i, 60 + i % 50) if i % 2 else " ".join(w + "on" for w in edge.prose(i, 60).split())) for i in range(120)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for parts in (1, 8, 64):
        got.append({r.doc_id: (r.score, r.base_score, r.n_known) for r in lm_scoring.score_texts(docs.repartition(parts), Shared(spark), rounds=2).collect()})
    for other in got[1:]:
        assert all(other[d][2] == n and other[d][1] == pytest.approx(b) and other[d][0] == pytest.approx(s, rel=1e-4) for d, (s, b, n) in got[0].items())


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(7).normal(size=(60, len(quality_classifier.STATS))) * 0.7
    z = quality_classifier.features(x)[:, :-1]
    exact = np.exp(-quality_classifier.SPREAD * ((x[:, None] - x[None]) ** 2).sum(-1))
    error = z @ z.T - exact
    assert np.abs(error).mean() < 1.5 / np.sqrt(quality_classifier.FEATURES) and np.abs(error).max() < 0.4


def test_normal_equations_equal_the_whole_solution(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, len(quality_classifier.STATS))) * rng.uniform(0.5, 3, len(quality_classifier.STATS))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.5).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, quality int").repartition(7)
    model = quality_classifier.train(rows)
    z = quality_classifier.features((x - x.mean(0)) / x.std(0))
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    want = np.linalg.solve((z * w[:, None]).T @ z + quality_classifier.RIDGE * np.eye(z.shape[1]), z.T @ (w * y))
    assert np.allclose(model.weights, want, atol=1e-6)


def test_training_of_the_field_takes_one_text_an_id(spark):
    docs = [(1, edge.prose(i, 60)) for i in range(50)] + [(2, "x $$$ " * 60), (3, edge.prose(99, 80))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality_rules.train(frame(docs), labels)
    assert field == quality_rules.train(frame(docs[::-1] * 2), labels)
    assert field in [quality_rules.train(frame([d, *docs[50:]]), labels) for d in docs[:50]]
