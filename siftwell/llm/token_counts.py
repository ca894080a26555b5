"""Exact token lengths of all documents, as a histogram that answers every context limit.

Each text is encoded with a byte-pair tokenizer (its vocabulary file is a parameter, read
on the driver and broadcast: a vocabulary has a fixed size).  Only the length leaves the
task; lengths are aggregated with a map-side combine.  Suffix sums over the histogram then
give, for a context limit L: documents and tokens of length >= L, hence totals, quantiles
and the tokens left after truncation to L.

Scale: the histogram has one row per distinct length.  Suffix sums run inside blocks of
``block`` lengths and over the block totals, so no single task holds the histogram.

Defined cases: null and empty texts have length 0 and are counted; a very long text is encoded
whole; repeated rows count each; an empty table gives an empty histogram; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, map_arrow, read, utf8

TOKENIZER = os.environ.get("SIFTWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The vocabulary's split rule, a fixed value: letters, digits, other signs and white space apart.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTEXTS = (512, 1024, 2048, 4096, 8192, 32768)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs' doc_id with n_tokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks(tokenizer))

    def count(batches):
        import tiktoken

        encoder = tiktoken.Encoding("siftwell", pat_str=PATTERN, mergeable_ranks=vocabulary.value, special_tokens={})
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(text.decode("utf-8", "replace"))) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", utf8("text").alias("text")), count, f"doc_id {kind}, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)"""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = 256) -> DataFrame:
    """The histogram with docs_from and tokens_from (length >= n_tokens), docs_up_to, total_tokens,
    quantile (share of documents of at most this length) and truncated_tokens (limit n_tokens)."""
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"), F.sum("block_docs").over(everything).alias("total_docs"), F.sum("block_tokens").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    rows = rows.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum("tokens").over(inside)).join(blocks, "block")
    docs_from, tokens_from = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    up_to = F.col("total_docs") - docs_from + F.col("n_docs")
    return rows.select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), up_to.alias("docs_up_to"), (up_to / F.col("total_docs")).alias("quantile"), (F.col("total_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_tokens"), "total_tokens")


def context_report(sums: DataFrame, limits: tuple[int, ...] = CONTEXTS) -> DataFrame:
    """For each context limit: documents over it, all tokens, tokens after truncation. Limits are a short fixed list."""
    at = sums.crossJoin(F.broadcast(sums.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")))
    over = F.col("n_tokens") > F.col("context_limit")
    return at.groupBy("context_limit").agg(F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"), F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sums read the histogram twice; saved, texts are encoded once
    return suffix_sums(Shared(spark).save(histogram(encoded_lengths(read(spark, sf_dir, "documents"))), "histogram"))
