"""Every operator on a table with one very long text (2 MB and more, 200 KB for the language model, whose steps are one after the other)."""

import hashlib
import json

import edge
import pytest

from siftwell.llm import benchmark_decontamination, chat_formatting, curriculum_mixing, line_dedup, lm_scoring, minhash_near_dedup, quality_classifier, quality_rules, suffix_array_dedup, token_counts
from siftwell.llm.common import Shared

SHORT = edge.prose(4000, 120)


@pytest.fixture(scope="module")
def long_text():
    # no hundred bytes of it occur twice: numbered words stand between
    words = edge.prose(4001, 320_000).split(" ")
    return " ".join(w if i % 6 else f"{w} n{i}" for i, w in enumerate(words))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    assert len(long_text.encode()) > 2_000_000
    rows = [(1, SHORT, "s"), (2, long_text, "s"), (3, long_text + " and a few words more", "t"), (4, long_text[:1_000_000] + SHORT, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_suffix_array(spark, docs, long_text):
    out = {r.doc_id: r for r in suffix_array_dedup.dedup_substrings(docs, Shared(spark)).collect()}
    assert [out[d].n_removed for d in (1, 2)] == [0, 0]
    assert out[3].n_removed == len(long_text.encode()) and bytes(out[3].kept_bytes) == b" and a few words more"
    assert out[4].kept_sha256 == hashlib.sha256(b"").hexdigest() or out[4].n_removed >= len(long_text[:1_000_000].encode())


def test_near_duplicates(spark, docs):
    out = {r.doc_id: r.component_id for r in minhash_near_dedup.near_duplicates(docs, Shared(spark)).collect()}
    assert out == {1: 1, 2: 2, 3: 2, 4: 4}


def test_maps_over_texts(spark, docs, long_text):
    n = len(long_text.encode().split())
    judged = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.Field()).collect()}
    assert judged[2].n_words == n and judged[2].kept and len(judged[2].line_labels) == long_text.count("\n") + 1
    items = spark.createDataFrame([(1, " ".join(long_text.split()[-15:]))], "item_id long, text string")
    hit = {r.doc_id: r.n_items for r in benchmark_decontamination.decontaminate(docs, items).collect()}
    assert hit == {1: 0, 2: 1, 3: 1, 4: 0}
    assert {r.doc_id: r.n_tokens > n for r in token_counts.encoded_lengths(docs).collect()}[2]
    mixed = {r.doc_id: r for r in curriculum_mixing.mix(docs).collect()}
    assert mixed[2]["size"] == n and 0 < mixed[2].taken <= 2 * n
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels, Shared(spark)).collect())


def test_lines(spark, docs, long_text):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, Shared(spark)).collect()}
    assert out[2].n_removed == 0 and out[3].n_removed >= long_text.count("\n") and len(out[4].kept_text) < 200


def test_chats(spark, long_text):
    say = json.dumps({"tool_calls": [{"id": "c", "name": "reply", "arguments": {"prompt": long_text, "words": 5}}]})
    rows = spark.createDataFrame([(1, 0, "assistant", say), (1, 1, "tool", json.dumps({"tool_call_id": "c", "content": long_text}))], "conv_id long, turn long, role string, text string")
    out = {r.kind: r for r in chat_formatting.format_chats(chat_formatting.explicit_calls(rows), Shared(spark)).collect()}
    assert out["call"].valid and out["result"].linked and json.loads(out["call"].canonical_json)["arguments"]["prompt"] == long_text


def test_language_model(spark, long_text):
    rows = [(1, SHORT), (2, long_text[:200_000]), (3, "word " * 30)]
    out = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), Shared(spark), rounds=1).collect()}
    assert out[2].n_tokens == len(long_text[:200_000].encode().split()) + 1 and out[2].score < out[1].score < 0
