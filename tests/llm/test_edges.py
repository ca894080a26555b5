"""Every operator on the troublesome table and on empty ones."""

import edge
import pytest

from siftwell.llm import benchmark_decontamination, chat_formatting, lm_scoring, minhash_near_dedup, quality_classifier, suffix_array_dedup, token_counts
from siftwell.llm.common import Shared

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


@pytest.mark.parametrize("name", sorted(edge.OPERATORS_KEEPING_ROWS))
def test_rows_and_other_columns_stay(spark, edges, shared, name):
    out = edge.OPERATORS_KEEPING_ROWS[name](edges, shared)
    rows = out.collect()
    assert len(rows) == len(edge.texts())
    assert {"lang", "n_chars", "rank", "node", "key", "label"} <= set(out.columns)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _, _ in edge.texts())


@pytest.mark.parametrize("name", sorted(edge.OPERATORS_KEEPING_ROWS))
def test_empty_tables_of_row_keepers(spark, shared, name):
    assert edge.OPERATORS_KEEPING_ROWS[name](edge.table(spark, []), shared).count() == 0


def one_side(spark, docs):
    labels, items = spark.createDataFrame([], LABELS), spark.createDataFrame([], ITEMS)
    return {
        "classifier": quality_classifier.classify(docs, labels, Shared(spark)), "lm": lm_scoring.score_texts(docs, Shared(spark), rounds=1), "suffix": suffix_array_dedup.dedup_substrings(docs, Shared(spark)),
        "near": minhash_near_dedup.near_duplicates(docs, Shared(spark)), "benchmark": benchmark_decontamination.decontaminate(docs, items),
    }


def test_one_row_for_each_document(spark, edges):
    for name, out in one_side(spark, edges).items():
        assert out.count() == len(edge.texts()), name


def test_empty_tables(spark):
    for name, out in one_side(spark, edge.table(spark, [])).items():
        assert out.count() == 0, name
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(edge.table(spark, [])))).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_formatting.format_chats(chat_formatting.implied_calls(chats), Shared(spark)).count() == 0


def test_without_labels_the_default_field_judges(spark, edges):
    from siftwell.llm import quality_rules

    assert quality_rules.train(edges, spark.createDataFrame([], LABELS)) == quality_rules.Field()
