import hashlib
import json

import edge
import numpy as np
import pytest

from siftwell.llm import benchmark_decontamination, chat_formatting, curriculum_mixing, token_counts


def norm_words(text):
    return (text or "").encode().translate(benchmark_decontamination.NORMAL).split()


def brute_hits(text, items):
    words = norm_words(text)
    hit, found = set(), set()
    for item, t in items:
        w = norm_words(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("words", [10**6, 8])
def test_hits(spark, words):
    q = edge.prose(9, 30)
    items = [(1, q), (2, "Short one, here"), (10, None), (11, "..."), (12, edge.prose(10, 10)), (13, q.upper())]
    docs = [(1, "intro " + q + " outro"), (2, "has SHORT-one here! and more"), (3, " ".join(q.split()[5:16])), (4, " ".join(q.split()[5:14])), (5, None), (6, edge.prose(11, 50)), (7, "shortone here"), (8, "é " + q.replace(" ", "\n\n"))]
    out = benchmark_decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=words).collect()
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(dict(docs)[r.doc_id], items), r.doc_id


def test_offsets_map_to_the_original():
    q = b"Alpha, beta gamma: delta epsilon zeta eta theta iota kappa"
    text = "né — ".encode() + q + b" end"
    machine = benchmark_decontamination.automaton(benchmark_decontamination.item_windows([("1", q)]))
    _, spans, _ = benchmark_decontamination.hits(text, machine)
    (_, _, a, b), = spans
    assert text[a:b] == q


def brute_targets(sizes, weights, share, cap):
    left, total = dict(sizes), share * sum(sizes.values())
    target = {}
    while left:
        rate = (total - sum(target.values())) / sum(weights[s] for s in left)
        full = [s for s in left if rate * weights[s] >= cap * sizes[s]]
        if not full:
            return target | {s: rate * weights[s] for s in left}
        for s in full:
            target[s] = cap * left.pop(s)
    return target


def test_targets_and_takes(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.integers(0, 7))}" if i % 9 else None) for i in range(500)]
    out = curriculum_mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), buckets=8).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    for s in names:
        rows = [r for r in out if r.source == s]
        assert rows[0].target == pytest.approx(want[s]) and rows[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in rows) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) for r in out)
    assert all(0 <= r.position <= r.last_position <= 1 for r in out if r.position is not None)


def test_inverse_of_the_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for i, schedule in enumerate(curriculum_mixing.SCHEDULES):
        got = df.select("u", curriculum_mixing.inverse(F.col("u"), curriculum_mixing.knots(F.lit(i), curriculum_mixing.SCHEDULES)).alias("t")).collect()
        t, r = (np.array(x) for x in zip(*schedule, strict=True))
        grid = np.linspace(0, 1, 20001)
        area = np.concatenate([[0], np.cumsum((np.interp(grid[1:], t, r) + np.interp(grid[:-1], t, r)) / 2 * np.diff(grid))])
        for row in got:
            assert np.interp(row.t, grid, area / area[-1]) == pytest.approx(row.u, abs=1e-6)


def test_suffix_sums(spark):
    rng = np.random.default_rng(7)
    lengths = [*rng.integers(0, 2000, 400).tolist(), 0, 0, 5000]
    df = spark.createDataFrame([(int(n),) for n in lengths], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(df))
    x = np.array(lengths)
    for r in sums.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_up_to, r.truncated_tokens, r.total_tokens) == ((x == n).sum(), (x >= n).sum(), x[x >= n].sum(), (x <= n).sum(), np.minimum(x, n).sum(), x.sum())
    for r in token_counts.context_report(sums, (0, 100, 1024, 9999)).collect():
        assert (r.docs_over, r.truncated_tokens) == ((x > r.context_limit).sum(), np.minimum(x, r.context_limit).sum())


def test_lengths_equal_the_tokenizer(spark):
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks(token_counts.TOKENIZER), special_tokens={})
    rows = [(d, t) for d, t, _ in edge.texts()] + [(70, "<|endoftext|>")]
    out = token_counts.encoded_lengths(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(d), len(encoder.encode_ordinary(t or ""))) for d, t in rows)


REGISTRY = {"search": {"q": {"type": "string", "required": True}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "mode": {"type": "string", "enum": ["a", "b"]}}, "sum": {"xs": {"type": "array", "required": True}}}


def call(i, name, arguments, deps=None):
    return {"id": i, "name": name, "arguments": arguments} | ({"depends_on": deps} if deps else {})


def test_explicit_calls(spark, shared):
    say = lambda *calls: json.dumps({"tool_calls": list(calls)})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "ok"})
    rows = [
        (1, 0, "user", "find it"), (1, 1, "assistant", say(call("c1", "search", {"q": "x", "n": 2}), call("c2", "sum", {"xs": [1]}, ["c1"]), call("c3", "search", {"n": 9, "z": 1, "mode": "q"}))),
        (1, 2, "tool", answer("c2")), (1, 5, "tool", answer("c1")), (1, 6, "tool", answer("zz")), (1, 7, "assistant", "done {"),
        (2, 0, "assistant", say(call("a", "sum", {"xs": []}, ["b"]), call("b", "sum", {"xs": []}, ["a"]), call("a", "none", "{\"b\": 1, \"a\": {\"d\": 2, \"c\": 1}}"))), (3, 0, None, None), (None, 1, "tool", answer("c1")),
    ]
    made = chat_formatting.explicit_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_formatting.format_chats(made, shared, REGISTRY).collect()
    by = {(r.conv_id, r.kind, r.call_id, r.tool): r for r in out}
    first, second = by[1, "call", "c1", "search"], by[1, "call", "c2", "sum"]
    assert first.linked and first.valid and first.canonical_json == '{"arguments":{"n":2,"q":"x"},"id":"c1","name":"search","role":"assistant","type":"call"}'
    order = sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.place, r.depth, r.turn, r.call_id or ""))
    at = {(r.kind, r.call_id): i for i, r in enumerate(order)}
    assert at["call", "c1"] < at["result", "c1"] < at["call", "c2"] < at["result", "c2"] and second.place == 5
    assert by[1, "call", "c3", "search"].errors == ["q is missing", "n is above 5", "mode is none of the allowed values", "z is unexpected"]
    assert not by[1, "result", "zz", None].linked and by[1, "call", "c3", "search"].linked is False
    assert by[2, "call", "a", "sum"].cyclic and by[2, "call", "b", "sum"].cyclic
    assert by[2, "call", "a", "none"].errors == ["the tool is unknown"] and '"arguments":{"a":{"c":1,"d":2},"b":1}' in by[2, "call", "a", "none"].canonical_json
    assert by[3, "message", None, None].canonical_json == '{"content":null,"role":null,"type":"message"}'


def test_chains_of_calls_are_ordered_in_few_rounds(spark, shared, monkeypatch):
    say = lambda *calls: json.dumps({"tool_calls": list(calls)})
    n = 40
    # each call waits for the one before; results come late and in reverse; one call waits for the ends of two chains
    rows = [(1, i, "assistant", say(call(f"a{i}", "sum", {"xs": []}, [f"a{i - 1}"] if i else None))) for i in range(n)] + [(1, 500 - i, "tool", json.dumps({"tool_call_id": f"a{i}"})) for i in range(n)]
    rows += [(1, 600 + i, "assistant", say(call(f"b{i}", "sum", {"xs": []}, [f"b{i - 1}"] if i else None))) for i in range(n // 2)] + [(1, 50, "assistant", say(call("z", "sum", {"xs": []}, [f"a{n - 1}", f"b{n // 2 - 1}"])))]
    saved, save = [], shared.save
    monkeypatch.setattr(shared, "save", lambda df, name: saved.append(name) or save(df, name))
    made = chat_formatting.explicit_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {(r.kind, r.call_id): (r.place, r.depth) for r in chat_formatting.format_chats(made, shared, REGISTRY).collect()}
    place = 0
    for i in range(n):
        place = max(i, place)
        assert out["call", f"a{i}"] == (place, 2 * i)
        place = max(place, 500 - i)
        assert out["result", f"a{i}"] == (place, 2 * i + 1)
    assert out["call", f"b{n // 2 - 1}"] == (600 + n // 2 - 1, n - 2) and out["call", "z"] == (619, 2 * n)
    assert sum(x.startswith("fresh") for x in saved) <= 10


def test_calls_of_one_id_in_one_turn(spark, shared):
    text = json.dumps({"tool_calls": [call("c", "sum", {"xs": [1]}), call("c", "sum", {"xs": [2]})]})
    made = chat_formatting.explicit_calls(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string"))
    assert sorted((r.arguments, r.duplicate) for r in chat_formatting.format_chats(made, shared, REGISTRY).collect()) == [('{"xs":[1]}', False), ('{"xs":[2]}', True)]


def test_mixing_numbers_copies_of_a_hot_row_in_parts(spark, tmp_path):
    rows = [(None, "", "a", i) for i in range(400)] + [(7, "w w w", "a", i) for i in range(700)] + [(i, "w " * (i % 5), "ab"[i % 2], i) for i in range(300)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    plain.repartition(3).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    per_salt = stored.where("doc_id = 7 and text = 'w w w'").select(curriculum_mixing.salt(stored, 16).alias("salt")).groupBy("salt").count().collect()
    assert len(per_salt) > 10 and max(r["count"] for r in per_salt) < 150
    columns = ["doc_id", "text", "source", "size", "taken", "passes", "position", "last_position"]
    told = lambda docs, **more: sorted(map(str, curriculum_mixing.mix(docs, buckets=8, **more).select(columns).collect()))
    got = told(stored, salts=16)
    assert len(got) == len(rows) and got == told(plain) == told(stored, salts=4096)
    mixed = curriculum_mixing.mix(stored, buckets=8)
    assert mixed.where("doc_id = 7 and text = 'w w w' and position is not null").select("position").distinct().count() == mixed.where("doc_id = 7 and text = 'w w w' and position is not null").count() > 100
    assert sorted(r.extra for r in mixed.select("extra").collect()) == sorted(r[3] for r in rows)
