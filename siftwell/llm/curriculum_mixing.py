"""Mixing sources to target weights under a time-varying curriculum, in DataFrame functions only.

Each source has a weight and a schedule: its relative sampling rate over training time
[0, 1], piecewise linear between knots.  The integral of a source's rate, scaled, is the
number of words it owes (its target).  A document's words occupy a stretch of its
source's cumulative demand; inverting the cumulative rate turns that stretch into a
training position.  Documents are then range-sorted by position.

Targets: sources share ``share`` times all words by weight; none exceeds ``max_epochs``
times its own words, and the excess is reshared by weight until none is above.  Sorted by
saturation level (cap / weight) the full sources are a prefix, so the fixed point has a
closed form and needs no loop.

Scale: a running sum over a source would put a hot source into one task.  Documents are
dealt into hash buckets per source; windows run inside (source, bucket), and only the
bucket totals, at most ``buckets`` rows a source, are summed along a source.  Windows see
ids and sizes; whole rows move twice, to their place in the plan and by range.  Exact copies
of a row are dealt into ``salts`` groups by where they lie in their Parquet files, each group
an entry of the plan, so copies are numbered in parts.  A DataFrame that no longer knows its
files, such as one behind a join, should be written first: the copies of one row meet in one
task otherwise.

Defined cases: null or empty texts have size 0, get nothing and no position; documents of
one source are ordered by md5 of doc_id, then by doc_id and text hash, so reruns agree and
repeated rows each count; null sources form one source, ranked last; an empty table gives
an empty result; other columns pass through unless named like one of ours (those are
replaced); a very long text is one entry of its size and is taken in part if need be.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Shared, read

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Rates by rank, repeating: (time, rate) knots. Heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 2.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 3.0)))
OWN = ("size", "source_size", "target", "taken", "weight", "position", "last_position", "passes")


def cyclic(rank: Column, values: Sequence, kind: str) -> Column:
    made = F.array(*[F.lit(v).cast(kind) for v in values])
    return F.element_at(made, (rank % len(values)).cast("int") + 1)


def knots(rank: Column, schedules: Sequence) -> Column:
    """The schedule as an array of segments (t0, t1, r0, r1, area before)."""
    made = []
    for schedule in schedules:
        total, area, parts = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)), 0.0, []
        for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
            parts.append(F.struct(F.lit(t0).alias("t0"), F.lit(t1).alias("t1"), F.lit(r0 / total).alias("r0"), F.lit(r1 / total).alias("r1"), F.lit(area / total).alias("done")))
            area += (t1 - t0) * (r0 + r1) / 2
        made.append(F.array(*parts))
    return F.element_at(F.array(*made), (rank % len(schedules)).cast("int") + 1)


def inverse(share: Column, segments: Column) -> Column:
    """Training time at which the cumulative rate reaches share (0 to 1)."""
    seg = F.element_at(F.filter(segments, lambda s: (s["done"] <= share) | (s["done"] == 0.0)), -1)
    slope = (seg["r1"] - seg["r0"]) / (seg["t1"] - seg["t0"])
    need = F.greatest(share - seg["done"], F.lit(0.0))
    root = F.sqrt(F.greatest(seg["r0"] * seg["r0"] + 2 * slope * need, F.lit(0.0)))
    # the root of r0 * x + slope * x^2 / 2 = need that is stable for a slope of 0
    step = F.when(seg["r0"] + root > 0, 2 * need / F.when(seg["r0"] + root > 0, seg["r0"] + root).otherwise(1.0)).otherwise(0.0)
    return F.least(seg["t0"] + step, seg["t1"])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, schedules: Sequence = SCHEDULES, own: Mapping[str, float] | None = None) -> DataFrame:
    """(source, source_size) with the target, weight and schedule of each source. One row a source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = cyclic(F.col("rank"), weights, "double")
    if own:
        given = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.try_element_at(given, F.col("source")), weight)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    water = ranked.withColumn("demand", F.lit(float(share)) * F.sum("source_size").over(everything))
    water = water.withColumn("at", (F.col("demand") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the water stands at the first source that it does not fill
    water = water.withColumn("stand", F.min(F.when(F.col("at") < F.col("level"), F.struct("level", "rank", "at"))).over(everything)["at"])
    target = F.when(F.col("stand").isNull() | (F.col("stand") >= F.col("level")), F.col("cap")).otherwise(F.col("stand") * F.col("weight"))
    return water.select("source", "weight", target.alias("target"), knots(F.col("rank"), schedules).alias("schedule"), F.col("source_size").cast("long").alias("source_size"))


def salt(docs: DataFrame, salts: int) -> Column:
    """A number below ``salts`` that differs among copies of a row and is the same at each reading: from a row's file and place there; 0 where docs are no files with such places."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.lit(0).cast("long")
    return F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(salts))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, schedules: Sequence = SCHEDULES, own: Mapping[str, float] | None = None, buckets: int = 1024, salts: int = 4096, shared: Shared | None = None) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target, taken, weight, passes, position, last_position.

    taken: words the mix takes of the document, repeats counted; passes: how often it starts;
    position and last_position: training time of its first and last start (null if not taken).
    shared: keeps the entries of the plan, so that texts are read for their sizes once.
    """
    docs = docs.drop(*OWN)
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.withColumn("_salt", salt(docs, salts)).withColumn("_at", F.md5(text_id.cast("binary"))).withColumn("_tie", F.xxhash64(text_id, F.coalesce("text", F.lit("")), F.col("source")))
    # the plan is made of keys and sizes alone; repeated rows of one salt are one entry
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    entries = keyed.select("doc_id", "source", "_at", "_tie", "_salt", size.alias("size")).groupBy("source", "_at", "_tie", "_salt").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count("*").alias("_copies"))
    entries = entries.withColumn("_words", F.col("size") * F.col("_copies")).withColumn("_bucket", (F.conv(F.substring("_at", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    if shared is not None:
        entries = shared.save(entries, "entries")
    totals = entries.groupBy("source", "_bucket").agg(F.sum("_words").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    targets = source_targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs, schedules, own)
    plan = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("_s"), F.col("_bucket").alias("_b"), "_ahead", "source_size", "target", "weight", "schedule")
    inside = Window.partitionBy("source", "_bucket").orderBy("_at", "doc_id", "_tie", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("_inside", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    entries = entries.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).select(F.col("_at").alias("_a"), F.col("_tie").alias("_t"), F.col("_salt").alias("_r"), "size", "_ahead", "_inside", "source_size", "target", "weight", "schedule")
    # rows come back to their entry once, its repeats one after the other
    placed = keyed.join(entries, (F.col("_at") == F.col("_a")) & (F.col("_tie") == F.col("_t")) & (F.col("_salt") == F.col("_r")))
    repeat = F.row_number().over(Window.partitionBy("_at", "_tie", "_salt").orderBy("_at", "_tie")) - 1
    placed = placed.withColumn("_inside", F.col("_inside") + F.col("size") * repeat)
    goal, ahead_words = F.floor(F.col("target") + 0.5), F.col("_ahead") + F.col("_inside")
    takes = [F.greatest(F.least(goal - F.lit(i) * F.col("source_size") - ahead_words, F.col("size")), F.lit(0)) for i in range(max_epochs)]
    taken, passes = sum(takes[1:], takes[0]), sum([(x > 0).cast("int") for x in takes[1:]], (takes[0] > 0).cast("int"))
    placed = placed.withColumn("taken", taken.cast("long")).withColumn("passes", passes)
    at = lambda n: F.when(F.col("passes") > 0, inverse((ahead_words + n * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")).otherwise(1.0), F.col("schedule")))
    placed = placed.withColumn("position", at(F.lit(0))).withColumn("last_position", at(F.col("passes") - 1))
    return placed.select(*docs.columns, *OWN)


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents that are not taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def op8_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return by_position(mix(docs, shared=Shared(spark)).select("doc_id", "size", "source_size", "target", "taken", "position"))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS at FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0 AS cap FROM ranked),
leveled AS (SELECT *, cap / weight AS level FROM weighed),
water AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_level FROM leveled),
stand AS (SELECT arg_min(at_level, level) AS stand FROM water WHERE at_level < level),
targets AS (SELECT source, rank, source_size, CASE WHEN stand IS NULL OR stand >= level THEN cap ELSE stand * weight END AS target FROM water, stand),
placed AS (SELECT s.doc_id, s.size, t.rank, t.source_size, t.target, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.at, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, greatest(least(floor(target + 0.5) - ahead, size), 0) + greatest(least(floor(target + 0.5) - source_size - ahead, size), 0) AS taken, ahead / target AS share FROM placed),
timed AS (SELECT *,
  CASE rank % 3 WHEN 0 THEN 2 / 1.5 WHEN 1 THEN 1.0 ELSE CASE WHEN share < 0.45 / 1.25 THEN 0.5 / 1.25 ELSE 1 / 1.25 END END AS r0,
  CASE rank % 3 WHEN 0 THEN 1 / 1.5 WHEN 1 THEN 1.0 ELSE CASE WHEN share < 0.45 / 1.25 THEN 1 / 1.25 ELSE 3 / 1.25 END END AS r1,
  CASE WHEN rank % 3 = 2 AND share >= 0.45 / 1.25 THEN 0.6 ELSE 0.0 END AS t0,
  CASE WHEN rank % 3 = 2 AND share < 0.45 / 1.25 THEN 0.6 ELSE 1.0 END AS t1,
  CASE WHEN rank % 3 = 2 AND share >= 0.45 / 1.25 THEN 0.45 / 1.25 ELSE 0.0 END AS done FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN least(t0 + 2 * (share - done) / (r0 + sqrt(r0 * r0 + 2 * (r1 - r0) / (t1 - t0) * (share - done))), t1) END AS position
FROM timed
"""
