"""The corpus pipeline: documents in, a deduplicated, clean and mixed corpus out.

Each stage calls one operator and returns the documents it keeps, with the columns of
documents; the last adds the mix.  ``run`` writes each stage's result as Parquet to the
shared folder and reads it again, so a lost executor never reaches back beyond one stage.

1. quality rules: documents whose verdict is rejection go.
2. line dedup: later occurrences of repeated three-line windows go; a document that this
   leaves without words goes too.
3. MinHash near-dedup: one row of each component stays, the one of least doc_id.
4. benchmark decontamination: documents that hold a test window go.
5. source mixing: words taken and training position of each remaining document.

Defined cases, in every stage: null or empty texts fail the quality rules and go; rows with
a null doc_id are judged by their text like all others; near-dedup judges each row by its own
text, so several texts of one doc_id have verdicts of their own and of repeated rows one stays;
very long texts are read whole; an empty table, of
labels or benchmark items too, gives an empty result or leaves documents alone; further
columns stay as they are, whatever their names (the mix's own names replace them at the end).

ORACLE_SQL is None: Viterbi decoding with a trained field and MinHash components are no
SQL; tests/llm holds the stages against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import benchmark_decontamination, curriculum_mixing, line_dedup, minhash_near_dedup, quality_rules
from siftwell.llm.common import WORD, Shared, read


NEEDED = ("doc_id", "text", "n_chars")


def apart(docs: DataFrame) -> DataFrame:
    """docs with other columns out of the way of names that operators use."""
    return docs.toDF(*[c if c in NEEDED else f"_own_{i}" for i, c in enumerate(docs.columns)])


def back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from rows that descend from apart(docs)."""
    return out.select(*[F.col(c if c in NEEDED else f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return back(quality_rules.judge(apart(docs), field).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(apart(docs), Shared(spark))
    emptied = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(WORD)
    out = out.where(~emptied).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared = Shared(spark)
    # rows are told apart by a number, as several may share a doc_id, or have none
    rows = shared.save(apart(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    verdicts = minhash_near_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shared)
    members = verdicts.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least"))
    return back(rows.join(least.select("least._row"), "_row", "left_semi"), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = benchmark_decontamination.decontaminate(apart(docs), read(spark, sf_dir, "benchmark"))
    return back(out.where("not contaminated"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum_mixing.by_position(curriculum_mixing.mix(docs, shared=Shared(spark)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("curriculum_mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shared = read(spark, sf_dir, "documents"), Shared(spark)
    before = None
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), name)
        if before:
            shared.drop(before)
        before = name
    return docs
