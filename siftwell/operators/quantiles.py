"""Exact quantiles by linear interpolation, at any size.

Up to ``limit`` rows Spark's ``percentile`` does it in one pass; its state grows with the
distinct values of a column and ends in one task, so beyond that, and wherever all columns
together may have more than ``HELD`` values, ranks are selected: each pass counts a bounded
number of buckets of the ranges that hold the ranks, then narrows them.  A pass serves the
ranks of all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a range, the most values that are counted one by one, and ranges that a pass narrows.
BUCKETS, FEW, RANGES = 4096, 4096, 64
#: Values of all columns together that one task may have to hold for ``percentile``.
HELD = 1 << 23


def held_at_once(rows: int, columns: int, limit: int) -> bool:
    """Whether ``percentile`` may answer for so many rows and columns."""
    return rows <= limit and rows * columns <= HELD


@dataclass
class Sought:
    """The value at ``rank`` among those of a column between lo and hi, of which there are n."""

    column: int
    rank: int
    lo: float
    hi: float
    n: int


def narrowed(rows: DataFrame, ranges: list[tuple[int, float, float, int]]) -> dict[int, list[tuple[float, float, int]]]:
    """(lo, hi, n) of the non-empty buckets of each range (column, lo, hi, n), ascending, from one pass."""
    # the ranges of a column don't overlap, so that a row is in one of them at most
    of: dict[int, tuple[Column, Column]] = {}
    for g, (i, lo, hi, n) in enumerate(ranges):
        x, width = F.col(f"x{i}"), (hi - lo) / BUCKETS
        at = x if n <= FEW or width <= 0 else F.least(F.floor((x - lo) / width), F.lit(BUCKETS - 1)).cast("double")
        here = x.between(lo, hi)
        of[i] = (of[i][0].when(here, g), of[i][1].when(here, at)) if i in of else (F.when(here, g), F.when(here, at))
    long = rows.select(F.inline(F.array(*[F.struct(g.alias("g"), b.alias("b"), F.col(f"x{i}").alias("x")) for i, (g, b) in of.items()]))).where("b is not null")
    out: dict[int, list[tuple[float, float, int]]] = {}
    for r in sorted(long.groupBy("g", "b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect(), key=lambda r: r.lo):
        out.setdefault(r.g, []).append((r.lo, r.hi, r.n))
    return out


def at_ranks(df: DataFrame, wanted: list[tuple[Column, list[int]]]) -> list[list[float]]:
    """For each column its values (double) at 0-based ranks among the non-null ones."""
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, (c, _) in enumerate(wanted)])
    ends = rows.agg(*[F.struct(F.min(f"x{i}").alias("lo"), F.max(f"x{i}").alias("hi"), F.count(f"x{i}").alias("n")).alias(f"e{i}") for i in range(len(wanted))]).first()
    sought = [[Sought(i, k, ends[i].lo, ends[i].hi, ends[i].n) for k in ranks] for i, (_, ranks) in enumerate(wanted)]
    for s in (s for own in sought for s in own):
        if not 0 <= s.rank < s.n:
            raise IndexError(f"rank {s.rank} of {s.n} values")
    while True:
        live = [s for own in sought for s in own if s.lo < s.hi]
        if not live:
            return [[s.lo for s in own] for own in sought]
        ranges = sorted({(s.column, s.lo, s.hi, s.n) for s in live})[:RANGES]
        found = narrowed(rows, ranges)
        for g, key in enumerate(ranges):
            for s in (s for s in live if (s.column, s.lo, s.hi, s.n) == key):
                for lo, hi, n in found[g]:
                    if s.rank < n:
                        s.lo, s.hi, s.n = lo, hi, n
                        break
                    s.rank -= n


def nth_smallest(df: DataFrame, value: Column, rank: int) -> float:
    """The value (double) at 0-based rank among the non-null values."""
    return at_ranks(df, [(value, [rank])])[0][0]


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], limit: int) -> dict[str, list[float | None]]:
    """Quantiles of each named column; None for columns without values."""
    if not columns:
        return {}
    shares = F.array(*[F.lit(p) for p in probs])
    counts = dict(zip(columns, df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns.values())]).first(), strict=True))
    small = {k: c for k, c in columns.items() if counts[k] <= limit}
    if sum(counts[k] for k in small) > HELD:
        small = {}
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(*[F.percentile(c.cast("double"), shares).alias(f"q{i}") for i, c in enumerate(small.values())]).first()
        out = {k: list(row[i]) if row[i] is not None else [None] * len(probs) for i, k in enumerate(small)}
    large = [k for k in columns if k not in small]
    if large:
        places = {k: [p * (counts[k] - 1) for p in probs] for k in large}
        values = at_ranks(df, [(columns[k], [r for at in places[k] for r in (int(at), min(int(at) + 1, counts[k] - 1))]) for k in large])
        for k, own in zip(large, values, strict=True):
            out[k] = [own[2 * i] + (at - int(at)) * (own[2 * i + 1] - own[2 * i]) for i, at in enumerate(places[k])]
    return out
