import hashlib
import random
from collections import defaultdict

import edge
import numpy as np
import pytest

from siftwell.llm import bwt, suffix_array_dedup


def brute_blocks(groups, depth):
    seen = defaultdict(list)
    for g, texts in enumerate(groups):
        for t, x in enumerate(texts):
            for o in range(len(x) - depth + 1):
                seen[x[o : o + depth]].append((g, t, o))
    return sorted(sorted(v) for v in seen.values() if len(v) > 1)


@pytest.mark.parametrize("seed", range(30))
def test_repeated_intervals(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([b"ab", b"abc", bytes(range(256))])
    groups = [[bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 4))]
    groups[0].append(groups[-1][-1] + b"x")
    depth = rng.randint(1, 9)
    assert listed(groups, depth) == brute_blocks(groups, depth)


def listed(groups, depth):
    found = defaultdict(list)
    for block, *place in zip(*[x.tolist() for x in bwt.repeats(groups, depth)], strict=True):
        found[block].append(tuple(place))
    return sorted(sorted(v) for v in found.values())


def test_a_shard_out_of_order_is_not_merged(monkeypatch):
    # suffixes follow from the interleave and their shard's order, so a wrong order must show
    right = bwt.transform

    def scrambled(texts, depth=None):
        s, marks = right(texts, depth), len(texts)
        p = np.concatenate([np.arange(marks), marks + np.random.default_rng(len(s.symbols)).permutation(len(s.symbols) - marks)])
        to = np.argsort(p)
        return bwt.Shard(s.symbols[p], np.where(s.longer[p] >= 0, to[s.longer[p]], -1), s.text[p], s.offset[p])

    for seed in range(10):
        rng = random.Random(seed)
        groups = [[bytes(rng.choice(b"abc") for _ in range(20)) for _ in range(4)] for _ in range(3)]
        monkeypatch.setattr(bwt, "transform", right)
        assert listed(groups, 4) == brute_blocks(groups, 4)
        monkeypatch.setattr(bwt, "transform", scrambled)
        try:
            assert listed(groups, 4) != brute_blocks(groups, 4)
        except (ValueError, IndexError):
            pass


def test_merged_order_and_prefixes():
    rng = random.Random(4)
    groups = [[bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(3)] for _ in range(3)]
    shards = [bwt.transform(g) for g in groups]
    now, _, prefix = bwt.merged(shards, 50)
    at = [(g, int(t), int(o)) for g, s in enumerate(shards) for t, o in zip(s.text, s.offset, strict=True)]
    # end marks sort before all bytes, by shard and text
    order = {k: i for i, k in enumerate((g, t) for g, texts in enumerate(groups) for t in range(len(texts)))}
    suffix = [([b + 100 for b in groups[g][t][o:]] + [order[g, t]]) for g, t, o in (at[i] for i in now)]
    assert suffix == sorted(suffix)
    for i in range(1, len(suffix)):
        a, b = suffix[i - 1], suffix[i]
        assert prefix[i] == next(k for k in range(99) if a[k] != b[k])


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) by id, from (id, bytes) in order."""
    seen, out = set(), {}
    for i, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("many", "piece", "levels"), [(1024, 1 << 20, 1), (1, 300, 1), (3, 1 << 20, 2), (1, 1 << 20, 0)])
def test_removed_bytes(spark, shared, monkeypatch, many, piece, levels):
    monkeypatch.setattr(suffix_array_dedup, "MANY", many)
    monkeypatch.setattr(suffix_array_dedup, "LEVELS", levels)
    monkeypatch.setattr(suffix_array_dedup, "PIECE", piece)
    rows = [(d, t) for d, t, _ in edge.texts() if d is not None]
    rows += [(60 + i, edge.edited(edge.BASE, 40 + i, 0.03)) for i in range(12)] + [(80, "pre " + edge.BASE[:150] + " post"), (81, edge.BASE[:99]), (82, edge.BASE[:100])]
    want = brute(sorted({(d, (t or "").encode()) for d, t in rows}))
    out = suffix_array_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), shared)
    assert len(out.collect()) == len(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect()}
    assert got == want


def test_different_texts_of_one_id_all_take_part(spark, shared):
    other = edge.edited(edge.BASE, 7, 0.02)
    rows = [(1, edge.BASE), (2, edge.BASE), (2, edge.BASE + "!"), (2, other), (2, other), (None, "x" + edge.BASE), (None, other + "?"), (None, None), (None, ""), (3, edge.BASE[50:400] + other), (-(1 << 62), other)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    code = {r.text: r.code for r in frame.selectExpr("coalesce(text, '') text", "xxhash64(cast(coalesce(text, '') as binary)) code").collect()}
    order = sorted({(d is not None, d or 0, code[t or ""], t or "") for d, t in rows})
    want = brute([((known, d, t), t.encode()) for known, d, _, t in order])
    out = suffix_array_dedup.dedup_substrings(frame, shared).collect()
    expected = sorted((d is not None, d or 0, *want[d is not None, d or 0, t or ""]) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out) == expected
    assert sum(x[3] > 0 for x in expected) >= 6


def test_numbers_follow_ids_and_hashes(spark, shared):
    rows = spark.createDataFrame([(i % 7, f"text {i % 90}") for i in range(600)], "id long, text string").selectExpr("id doc_id", "cast(text as binary) text", "id")
    got = suffix_array_dedup.numbered(rows, shared).selectExpr("doc_id", "xxhash64(text) code", "id").distinct().orderBy("id").collect()
    assert [(r.doc_id, r.code) for r in got] == sorted({(r.doc_id, r.code) for r in got}) and len({r.id for r in got}) == len(got)
