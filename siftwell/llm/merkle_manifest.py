"""Merkle manifest of a dataset, with proofs looked up by coordinates.

A row's leaf is the hash of its fields.  The leaves of a group, in order, are the lowest
level of the group's tree; every ``FANOUT`` consecutive nodes hash into one node of the next
level until one is left, the subroot; the subroots, ordered by group, form a last tree whose
top is the root.  All nodes are a table (tree, level, idx, digest).

Proofs: from its index and the size of its group a leaf knows the coordinates (level, idx) of
all siblings on its way up.  It explodes them, joins the node table, orders what it gets and
concatenates it; folding leaf and siblings, level by level, must give the root.

Scale: texts are hashed where they are read; only digests move.  Indexes within a group come
from a range partition and counts by partition, so no group is sorted in one task.  Upper
nodes are siblings of very many leaves: the levels that hold at most ``UPPER`` nodes in all
trees together are looked up once for each node of the lowest such level, and broadcast
(that bound is checked; other small tables are only broadcast below ``SMALL`` rows).

Defined cases: null fields read as ``-``; a null group comes first, a null id sorts before
others and is never tampered with; rows of one id are ordered by their leaf, equal rows by
their place in the table; a group of one row has its leaf as subroot, one group its subroot
as root, and an empty table gives no rows; a very long text is hashed whole; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, read

FANOUT, UPPER, SMALL = 8, 1024, 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Trees have fewer levels than that: 8 ** 21 leaves.
DEEPEST = 21


def leaf(values: list[Column]) -> Column:
    """The hash of fields, each as its length in bytes, a colon and itself, or ``-`` for null."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*parts), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has few rows, by count; else as it is."""
    return F.broadcast(df) if rows <= SMALL else df


def depth_of(size: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    return functools.reduce(lambda a, b: a + b, [F.when(size > FANOUT**k, 1).otherwise(0) for k in range(DEEPEST)])


def at_level(count: Column, level: int) -> Column:
    """How many nodes of a level a tree of count leaves has."""
    return F.ceil(count / F.lit(float(FANOUT**level))) if level else count


def numbered(rows: DataFrame, order: list[str], shared: Shared, name: str) -> DataFrame:
    """rows with idx (their rank in ``tree`` by ``order``) and size (rows of the tree)."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = shared.save(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    parts = shared.save(dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")), f"{name}-parts")
    # a tree has a row here for each range that it reaches into
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    parts = parts.select("tree", "_part", shift.alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    return dealt.join(small(parts, parts.count()), ["tree", "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def grow(leaves: DataFrame, shared: Shared, name: str) -> DataFrame:
    """All nodes (tree, level, idx, digest, size) over leaves (tree, idx, digest, size); three levels a round."""
    current, level, found = leaves, 0, [leaves.withColumn("level", F.lit(0))]
    while True:
        runs = current.groupBy("tree", "size", F.floor(F.col("idx") / FANOUT**3).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("of"))
        rows, digests = runs, F.transform("of", lambda n: n["digest"])
        for up in (1, 2, 3):
            hashed = lambda i: F.sha2(F.array_join(F.slice(F.col(f"d{up - 1}"), i * FANOUT + 1, FANOUT), ""), 256)  # noqa: B023, E731  used at once
            rows = rows.withColumn("d0", digests) if up == 1 else rows
            rows = rows.withColumn(f"d{up}", F.transform(F.sequence(F.lit(0), F.ceil(F.size(f"d{up - 1}") / FANOUT).cast("int") - 1), hashed))
        made = F.array(*[F.struct(F.lit(level + up).alias("level"), F.col(f"d{up}").alias("digests"), (F.col("block") * FANOUT ** (3 - up)).alias("base")) for up in (1, 2, 3)])
        rows = rows.select("tree", "size", F.explode(made).alias("m")).where(F.col("m.level") <= depth_of(F.col("size")))
        rows = rows.select("tree", "size", F.col("m.level").alias("level"), F.col("m.base").alias("base"), F.posexplode("m.digests").alias("i", "digest"))
        rows = shared.save(rows.select("tree", "level", (F.col("base") + F.col("i")).alias("idx"), "digest", "size"), f"{name}-{level}")
        found.append(rows)
        level += 3
        current = rows.where(F.col("level") == level)
        if not current.where(F.col("size") > FANOUT**level).limit(1).count():
            return functools.reduce(lambda a, b: a.unionByName(b), found)


def ways(leaves: DataFrame, nodes: DataFrame, first: int, last: int) -> DataFrame:
    """leaves (tree, idx, size, own), nodes of level ``first``, with steps: what stands left and right of their way at each level from first until before last.

    Siblings' coordinates come from idx and size alone; the node table gives their digests.
    """
    wanted = []
    for level in range(first, last):
        at = F.floor(F.col("idx") / FANOUT ** (level - first))
        low = F.floor(at / FANOUT) * FANOUT
        high = F.least(low + FANOUT, at_level(F.col("size"), level)) - 1
        of = F.transform(F.sequence(low, high), lambda i: F.struct(F.lit(level).alias("level"), i.alias("of"), (i > at).alias("right"), (i != at).alias("sibling")))  # noqa: B023  used at once
        wanted.append(F.when(F.col("size") > FANOUT**level, of).otherwise(F.array().cast("array<struct<level:int,of:bigint,right:boolean,sibling:boolean>>")))
    asked = leaves.select("tree", "idx", F.explode(F.concat(*wanted)).alias("w")).where("w.sibling").select("tree", "idx", "w.level", "w.of", "w.right")
    got = asked.join(nodes.where(F.col("level").between(first, last - 1)).select("tree", "level", F.col("idx").alias("of"), "digest"), ["tree", "level", "of"])
    got = got.select("tree", "idx", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast(leaves.schema["own"].dataType).alias("own"), F.struct("level", "of", "right", "digest").alias("s"))
    own = leaves.select("tree", "idx", "size", "own", F.lit(None).cast(got.schema["s"].dataType).alias("s"))
    out = own.unionByName(got).groupBy("tree", "idx").agg(F.max("size").alias("size"), F.any_value("own", F.lit(True)).alias("own"), F.array_sort(F.collect_list("s")).alias("s"))
    side = lambda level, right: F.array_join(F.transform(F.filter("s", lambda x: (x["level"] == level) & (x["right"] == right)), lambda x: x["digest"]), "")
    steps = F.array(*[F.when(F.col("size") > FANOUT**level, F.struct(side(level, False).alias("left"), side(level, True).alias("right"))) for level in range(first, last)])
    return out.select("tree", "idx", "size", "own", F.filter(steps, lambda x: x.isNotNull()).alias("steps"))


STEPS = "array<struct<left:string,right:string>>"


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(steps, digest, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


@dataclass
class Manifest:
    """nodes: all trees' nodes; tops: (tree, subroot, root, top_steps), a row a group; leaves: (tree, idx, size, own)."""

    nodes: DataFrame
    tops: DataFrame
    leaves: DataFrame
    n_tops: int


def manifest(leaves: DataFrame, shared: Shared) -> Manifest:
    """The trees over leaves (tree, digest, order columns in ``rank``, anything in ``own``)."""
    rows = shared.save(numbered(leaves, ["rank"], shared, "ranked").select("tree", "idx", "size", "digest", "own"), "leaves")
    shared.drop("ranked")
    nodes = grow(rows.select("tree", "idx", "digest", "size"), shared, "nodes")
    ends = nodes.where(F.col("level") == depth_of(F.col("size"))).select(F.lit("").alias("tree"), F.col("tree").alias("rank"), "digest")
    ends = shared.save(numbered(ends, ["rank"], shared, "ends"), "subroots")
    top = grow(ends.select("tree", "idx", "digest", "size"), shared, "tops")
    head = top.where(F.col("level") == depth_of(F.col("size"))).select(F.col("digest").alias("root"))
    sized = ends.select("tree", "idx", "size", F.struct("rank", "digest").alias("own"))
    levels = depth(ends)
    held = ways(sized, top, 0, levels) if levels else sized.withColumn("steps", F.array().cast(STEPS))
    # the root is one row
    tops = shared.save(held.select(F.col("own.rank").alias("tree"), F.col("own.digest").alias("subroot"), F.col("steps").alias("top_steps")).crossJoin(F.broadcast(head)), "groups")
    return Manifest(nodes, tops, rows, tops.count())


def depth(leaves: DataFrame) -> int:
    return leaves.agg(F.max(depth_of(F.col("size")))).first()[0] or 0


def cut(leaves: DataFrame, levels: int, upper: int = UPPER) -> int:
    """The lowest level of which all trees together hold at most ``upper`` nodes."""
    sizes = leaves.where("idx = 0").select("size")
    held = [F.sum(F.when(F.col("size") > FANOUT ** (k - 1), at_level(F.col("size"), k)).otherwise(0)) for k in range(1, levels + 1)]
    counts = sizes.agg(*[h.alias(str(k)) for k, h in enumerate(held, 1)]).first() if levels else ()
    return next((k for k, n in enumerate(counts, 1) if (n or 0) <= upper), levels)


def proofs(made: Manifest, shared: Shared, upper: int = UPPER) -> DataFrame:
    """(tree, own, subroot, root, steps): each leaf's way up to the root."""
    levels = depth(made.leaves)
    low = cut(made.leaves, levels, upper)
    held = ways(made.leaves.select("tree", "idx", "size", "own"), made.nodes, 0, low) if low else made.leaves.withColumn("steps", F.array().cast(STEPS))
    if low < levels:
        starts = made.nodes.where((F.col("level") == low) & (F.col("size") > FANOUT**low)).select("tree", "idx", "size", F.lit(0).alias("own"))
        above = shared.save(ways(starts, made.nodes, low, levels).select("tree", F.col("idx").alias("up"), F.col("steps").alias("more")), "upper")
        held = held.withColumn("up", F.floor(F.col("idx") / FANOUT**low)).join(F.broadcast(above), ["tree", "up"], "left")
        held = held.withColumn("steps", F.concat("steps", F.coalesce("more", F.array().cast(STEPS))))
    held = held.join(small(made.tops, made.n_tops), "tree")
    return held.select("tree", "own", "subroot", "root", F.concat("steps", "top_steps").alias("steps"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """The leaves of documents by language, with the leaf that the document gives when tampered with.

    tree: the language with a sign before it, so that no language (empty) sorts first."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select(*FIELDS).withColumn("digest", leaf(fields))
    now = F.when(tampered(F.col("doc_id")), leaf([*fields[:-1], lower])).otherwise(F.col("digest"))
    rows = rows.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "digest", F.struct("doc_id", F.col("digest").alias("leaf"), now.alias("now")).alias("own"))
    return rows.withColumn("rank", F.struct(F.col("own.doc_id"), F.col("digest"), F.monotonically_increasing_id()))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark)
    out = proofs(manifest(shared.save(leaves_of(read(spark, sf_dir, "documents")), "digests"), shared), shared)
    folded = fold(F.col("own.now"), F.col("steps"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("own.doc_id", "own.leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    """The same trees by windows and grouping, up to 8 ** 6 rows a language; crc32 bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc32 = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    made = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {made('text')} AS leaf, CASE WHEN {crc32} % 3 = 0 THEN {made(lower)} ELSE {made('text')} END AS now FROM documents)"]
    parts.append("t0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, leaf AS h FROM d)")
    parts.append("f0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, doc_id, leaf, now AS a, '' AS p FROM d)")

    def climb(t: str, f: str, n: int, keys: str) -> None:
        for k in range(n):
            parts.append(f"{t}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN m = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {t}{k}) GROUP BY g, i // 8, m)")
            parts.append(f"{f}{k + 1}s AS (SELECT f.{keys}, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < f.i), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > f.i), '') AS r, any_value(c.m) AS m FROM {f}{k} f JOIN {t}{k} t ON f.g = t.g AND f.i // 8 = t.i // 8 JOIN (SELECT g, count(*) AS m FROM {t}{k} GROUP BY g) c ON c.g = f.g GROUP BY f.{keys})")
            parts.append(f"{f}{k + 1} AS (SELECT f.* REPLACE (f.i // 8 AS i, CASE WHEN m = 1 THEN a ELSE sha256(l || a || r) END AS a, CASE WHEN m = 1 THEN p ELSE p || l || r END AS p) FROM {f}{k} f JOIN {f}{k + 1}s s USING ({keys}))")

    climb("t", "f", 6, "doc_id")
    parts.append("u0 AS (SELECT 1 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM t6)")
    parts.append("sub AS (SELECT t6.g AS own, h AS subroot FROM t6)")
    parts.append("v0 AS (SELECT 1 AS g, n.i, f6.doc_id, f6.g AS own, leaf, a, p FROM f6 JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM t6) n ON n.g = f6.g)")
    climb("u", "v", 3, "doc_id")
    parts.append("o AS (SELECT doc_id, leaf, subroot, u3.h AS root, sha256(p) AS proof_sha256, a AS folded_root FROM v3 JOIN sub USING (own) CROSS JOIN u3)")
    return "WITH " + ",\n".join(parts) + "\nSELECT *, folded_root = root AS verified FROM o"


ORACLE = _oracle()
