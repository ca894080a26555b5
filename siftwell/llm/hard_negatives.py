"""Hard negatives by a full sort of scores.

Vectors become integers, so scores are exact.  Anchors meet all rows in blocks: for a block
of rows an anchor's scores are computed, sorted by score (descending) and id, and read: for
positives the first rows of the anchor's label; for negatives, from the first score at or
below a positive's (binary search), the first rows of other labels down to the lower limit.
The best of each slot of rows are merged by Spark, so the result is that of one sort of all.

Scale: anchors are dealt into blocks of about ``ANCHORS``, each collected and broadcast in
turn (its size is bounded), and all rows are streamed past it from ``slots`` of even size; a
task holds one block of ``ROWS`` rows and the best of its slot.  A slot gives at most as many
rows as an anchor's answer, whatever the labels and however many vectors are equal.

Defined cases: rows with a null label, a null vector or a null or non-finite component take
no part; components count up to 2 ** 26 times 1/256 in size (larger ones as that); missing
components of shorter vectors count as zero; a null id is no anchor and comes last among
equal scores; "other" rows are those of another id, and repeated rows count each, but equal
rows of one anchor are one anchor; an empty table, or one without anchors, gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, map_arrow, read

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
ANCHORS, ROWS, SLOT_ROWS = 4096, 4096, 1_000_000
NO_ID, MOST = np.iinfo(np.int64).max, 2**26


def vectors(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, vector): rows that take part, their components as integers."""
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"))


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can round."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def row_blocks(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(slot, ids, labels, vectors) of at most so many rows of one slot; rows come sorted by slot."""
    for batch in batches:
        slot = batch.column(0).to_numpy()
        ids = batch.column(1).fill_null(NO_ID).to_numpy()
        labels = batch.column(2).to_numpy()
        held, at = batch.column(3), np.flatnonzero(np.diff(slot)) + 1
        for lo, hi in zip([0, *at], [*at, len(slot)], strict=True):
            for i in range(lo, hi, most):
                part = held.slice(i, min(most, hi - i))
                flat, ends = part.flatten().to_numpy(), part.offsets.to_numpy() - part.offsets[0].as_py()
                yield int(slot[lo]), ids[i : i + len(part)], labels[i : i + len(part)], [flat[ends[k] : ends[k + 1]] for k in range(len(part))]


class Block:
    """Anchors of one block: id, label and vector of each, and its positives' ids and scores once known."""

    def __init__(self, anchors: list[tuple[int, int, list[int]]]) -> None:
        self.ids = np.array([a for a, _, _ in anchors], np.int64)
        self.labels = np.array([x for _, x, _ in anchors], np.int64)
        self.vectors = [np.array(v, np.int64) for _, _, v in anchors]
        self.positives: list[list[tuple[int, int]]] = []

    def sorted_scores(self, vectors: list[np.ndarray], ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor's number, order of the rows by score and id, scores in that order)"""
        width = max(map(len, [*self.vectors, *vectors]), default=0)
        rows = matrix(vectors, width)
        for lo in range(0, len(self.ids), 256):
            got = scores(matrix(self.vectors[lo : lo + 256], width), rows)
            for k, s in enumerate(got):
                order = np.lexsort((ids, -s))
                yield lo + k, order, s[order]


def best(block: Block, batches: Iterator[pa.RecordBatch], negatives: bool, high: int = HIGH, low: int = LOW) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's number, positive's number or 0, score, id): the first few entries of every slot, kept while it is streamed."""
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    now = None
    for slot, ids, labels, vectors in row_blocks(batches):
        if slot != now:
            yield from ((a, p, -s, i) for (a, p), rows in held.items() for s, i in rows)
            held, now = {}, slot
        for a, order, s in block.sorted_scores(vectors, ids):
            same = labels[order] == block.labels[a]
            if not negatives:
                at = np.flatnonzero(same & (ids[order] != block.ids[a]))[:POSITIVES]
                if len(at):
                    held[a, 0] = sorted([*held.get((a, 0), []), *zip((-s[at]).tolist(), ids[order[at]].tolist(), strict=True)])[:POSITIVES]
                continue
            other = np.flatnonzero(~same)
            fall = -s[other]
            for p, (_, score) in enumerate(block.positives[a]):
                first = np.searchsorted(fall, -score, "left")
                least = -(-low * score // high)
                last = np.searchsorted(fall, -least, "right")
                at = other[first : min(last, first + NEGATIVES)]
                if len(at):
                    held[a, p] = sorted([*held.get((a, p), []), *zip((-s[at]).tolist(), ids[order[at]].tolist(), strict=True)])[:NEGATIVES]
    yield from ((a, p, -s, i) for (a, p), rows in held.items() for s, i in rows)


def scanned(rows: DataFrame, block: Block, negatives: bool, most: int) -> DataFrame:
    """The best ``most`` entries of all rows for each anchor and positive of the block: (anchor, positive, rank, score, id)."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def work(batches):
        found = list(best(sent.value, batches, negatives))
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["anchor", "positive", "score", "id"])

    order = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "id")
    dealt = rows.repartition("slot").sortWithinPartitions("slot").select("slot", "id", "label", "vector")
    found = map_arrow(dealt, work, "anchor int, positive int, score long, id long", ROWS)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, shared: Shared, anchors_a_block: int = ANCHORS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, vector); anchor says which are anchors."""
    spark = rows.sparkSession
    rows = shared.save(rows, "rows")
    slots = max(12, -(-rows.count() // slot_rows))
    dealt = shared.save(rows.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int")), "slots")
    anchors = rows.where(anchor & F.col("id").isNotNull()).distinct()
    count = max(1, -(-anchors.count() // anchors_a_block))
    anchors = shared.save(anchors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(count))), "anchors")
    out = None
    for b in range(count):
        # about ``anchors_a_block`` rows
        block = Block([(r.id, r.label, r.vector) for r in anchors.where(F.col("block") == b).orderBy("id", "label", "vector").collect()])
        block.positives = [[] for _ in block.ids]
        # at most five rows an anchor of the block
        for r in scanned(dealt, block, False, POSITIVES).orderBy("anchor", "rank").collect():
            block.positives[r.anchor].append((r.id, r.score))
        found = scanned(dealt, block, True, NEGATIVES)
        known = spark.createDataFrame([(a, p, int(block.ids[a]), i, s) for a, row in enumerate(block.positives) for p, (i, s) in enumerate(row)], "anchor int, positive int, anchor_id long, positive_id long, positive_score long")
        null = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
        joined = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(known), ["anchor", "positive"])
        part = shared.save(joined.select("anchor_id", null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score"), f"negatives-{b}")
        out = part if out is None else out.unionByName(part)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors(read(spark, sf_dir, "embeddings"), label), F.col("id") % 100 == 0, Shared(spark))


ORACLE = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
