"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a text (lengths, shares of signs, repetition, byte entropy) are standardised
and mapped to cosines whose inner products approximate a Gaussian kernel.  Normal
equations are summed per partition and added up; the driver solves one small ridge
system.  Raw scores of the training rows, counted in ``BINS`` bins, are pooled into a
non-decreasing function (isotonic regression), which maps scores to probabilities.

Only rows with crc32(doc_id as text) mod 3 other than 1 and a label 0 or 1 are learnt
from; labels, lang, source and doc_id are no inputs.  Random frequencies come from a fixed
seed.

Scale: texts are read once; their statistics (a few numbers a document) go to a shared
table that training and scoring read.  Partial sums have a fixed size, come from any number
of tasks and are added up in ``PARTS`` before they reach the driver.

Defined cases: null and empty texts have statistics of zeros and get a score like any
other; a very long text is read whole; other columns are not looked at; without labels of both kinds every score is the share of label 1 (0.5 without
labels); repeated rows each get the same score; several labels of a document: the largest
counts; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, crc_bucket, map_arrow, read, utf8
from .text_stats import NOT_DIGIT, NOT_LETTER, NOT_UPPER, WHITE, base_counts, kept

STATS = ("words", "word_length", "distinct", "symbols", "upper", "digits", "exclaims", "pipes", "beyond_ascii", "dup_lines", "repeats", "stutters", "line_words", "ends", "commas", "top_word", "entropy", "white")
FEATURES, SEED, RIDGE, SPREAD, BINS, PARTS = 192, 7, 1.0, 0.15, 1024, 32


def statistics(data: bytes) -> list[float]:
    if not data:
        return [0.0] * len(STATS)
    n, chars, symbols, dup, again, ids, distinct = base_counts(data)
    size, m, lines = len(data), max(1, n), max(1, data.count(b"\n") + 1)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = seen[seen > 0] / size
    stutter = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    return [
        float(np.log1p(n)), chars / m, distinct / m ** 0.9, min(3.0, symbols / m), kept(data, NOT_UPPER) / max(1, kept(data, NOT_LETTER)), kept(data, NOT_DIGIT) / size, min(2.0, data.count(b"!") / m), min(1.0, data.count(b"|") / m), seen[128:].sum() / size,
        dup / lines, again / m, stutter / m, float(np.log1p(n / lines)), min(1.0, (data.count(b".") + data.count(b"?")) / m), data.count(b",") / m, np.bincount(ids).max() / m if n else 0.0, float(-(share * np.log2(share)).sum()), seen[list(WHITE)].sum() / size,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with stats, an array of doubles."""

    def count(batches):
        for batch in batches:
            made = [statistics(data) for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", utf8("text").alias("text")), count, f"doc_id {kind}, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    low: float
    width: float
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def features(x: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    rng = np.random.default_rng(SEED)
    turn, shift = rng.normal(0, np.sqrt(2 * SPREAD), (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -6, 6) @ turn + shift), np.ones((len(x), 1))])


def isotonic(level: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing fit to ones/count at ascending levels (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for x, s, n in zip(level, ones, count, strict=True):
        blocks.append([x * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    # one pseudo-row of the overall rate in each block keeps scores inside (0, 1)
    rate = sum(b[1] for b in blocks) / sum(b[2] for b in blocks)
    values = np.maximum.accumulate([(b[1] + rate) / (b[2] + 1) for b in blocks])
    return np.array([b[0] / b[2] for b in blocks]), values


def added(sums: DataFrame, size: int) -> np.ndarray:
    """The total of the tasks' sums (doubles as bytes), added in ``PARTS`` tasks and then on the driver."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum((np.frombuffer(bytes(p.sums)) for p in sums.repartition(PARTS).mapInArrow(add, "sums binary").collect()), np.zeros(size))


def train(labelled: DataFrame) -> Model:
    """labelled: stats, quality (0 or 1)."""
    width = len(STATS)
    few = labelled.cache()
    sums = few.select(F.count("*").alias("n"), F.sum("quality").alias("ones"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]).first()
    n, ones = sums["n"] or 0, sums["ones"] or 0
    if not 0 < ones < n:
        few.unpersist()
        rate = ones / n if n else 0.5
        return Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), 0.0, 1.0, np.array([0.0]), np.array([rate]))
    mean = np.array([sums[f"m{i}"] for i in range(width)])
    scale = np.array([max(sums[f"s{i}"], 1e-6) for i in range(width)])
    # both labels weigh the same in the equations
    weight = {0: n / (2 * (n - ones)), 1: n / (2 * ones)}

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist()).reshape(-1, width), np.array(batch.column(1).to_pylist(), np.float64)
            z, w = features((x - mean) / scale), np.where(y == 1, weight[1], weight[0])
            total[:, :-1] += (z * w[:, None]).T @ z
            total[:, -1] += z.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = few.select("stats", F.col("quality").cast("int").alias("quality"))
    total = added(rows.mapInArrow(equations, "sums binary"), (FEATURES + 1) * (FEATURES + 2)).reshape(FEATURES + 1, FEATURES + 2)
    weights = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(FEATURES + 1), total[:, -1])
    model = Model(mean, scale, weights, -0.5, 2.0, np.array([0.0]), np.array([0.0]))

    def binned(batches):
        got = np.zeros((BINS, 2))
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist()).reshape(-1, width), np.array(batch.column(1).to_pylist(), np.float64)
            at = np.clip((model.raw(x) - model.low) / model.width * BINS, 0, BINS - 1).astype(int)
            np.add.at(got, at, np.stack([np.ones(len(y)), y], 1))
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["sums"])

    got = added(rows.mapInArrow(binned, "sums binary"), BINS * 2).reshape(BINS, 2)
    few.unpersist()
    full = got[:, 0] > 0
    levels = (model.low + (np.arange(BINS) + 0.5) / BINS * model.width)[full]
    knots, values = isotonic(levels, got[full, 1], got[full, 0])
    return Model(mean, scale, weights, model.low, model.width, knots, values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """stats (doc_id, stats, ...) with score and predicted."""

    def rate(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(STATS))
            got = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = dict(stats.dtypes)["doc_id"]
    return map_arrow(stats.select("doc_id", "stats"), rate, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, shared: Shared) -> DataFrame:
    """doc_id, held_out, score, predicted of all docs."""
    stats = shared.save(with_statistics(docs), "stats")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = stats.where(crc_bucket(F.col("doc_id"), 3) != 1).join(known, "doc_id").select("stats", "quality")
    out = score(stats, train(labelled))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"), Shared(spark))
