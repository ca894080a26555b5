"""Line dedup over overlapping windows of three lines.

The lines of a text are its ``\\n``-separated parts; those that are blank after trimming
are skipped when windows are formed.  Every three consecutive non-blank lines, trimmed,
make a window.  A window that also occurs earlier (smaller doc_id, or the same document at
an earlier line) covers its three lines; covered stretches are merged, blank lines between
them included, and removed.  Windows are judged on the input, not on what is left.

Scale: windows travel as 128-bit hashes with their place, never with text; first
occurrences are a partial aggregate, so a window found in a third of all documents costs
one row a task and goes to a shared table; the join back has plain exchanges on both sides,
so adaptive execution can broadcast it or split hot windows.

Defined cases: null text is an empty text with no lines; a very long text is one array of
lines, whole; texts of fewer than three
non-blank lines have no window and stay as they are; rows that repeat doc_id and text count
as one document and get the same verdict; rows with the same doc_id and other texts are
ordered by text hash; null doc_ids come before all others; an empty table gives an empty
result; columns named like ours are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, read

OWN = ("n_lines", "n_removed", "n_spans", "kept_text")
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    """(at, line) of the non-blank lines, trimmed."""
    parts = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    return F.filter(parts, lambda p: p["line"] != "")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_key", F.xxhash64("_text"))


def windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, key, pos): one row a window; pos counts non-blank lines."""
    hashed = F.transform(lines_of(F.col("_text")), lambda p: F.struct(F.xxhash64(p["line"]).alias("a"), F.xxhash64(F.lit("2"), p["line"]).alias("b")))
    rows = docs.select("doc_id", F.col("_key").alias("key"), hashed.alias("hashes"))
    rows = rows.where(F.size("hashes") >= 3)
    h = F.col("hashes")
    made = F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda j: F.struct(F.xxhash64(F.element_at(h, j)["a"], F.element_at(h, j + 1)["a"], F.element_at(h, j + 2)["a"]).alias("h1"), F.xxhash64(F.element_at(h, j)["b"], F.element_at(h, j + 1)["b"], F.element_at(h, j + 2)["b"]).alias("h2"), (j - 1).alias("pos")))
    return rows.select("doc_id", "key", F.inline(made)).select("h1", "h2", "doc_id", "key", "pos")


def repeated(docs: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, key, found): the windows of each document that occur earlier, as an array."""
    rows = windows(docs)
    place = F.struct("doc_id", "key", "pos")
    firsts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    firsts = shared.save(firsts, "firsts")
    later = rows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("found"))


def dedup_lines(docs: DataFrame, shared: Shared) -> DataFrame:
    """docs with n_lines, n_removed (lines), n_spans (merged stretches) and kept_text."""
    docs = docs.drop(*OWN)
    base = keyed(docs)
    found = repeated(base, shared).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.array_sort("found").alias("_found"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    p, n = F.coalesce("_found", F.array().cast("array<int>")), F.size(F.coalesce("_found", F.array().cast("array<int>")))
    # the first and last windows of each merged stretch: no neighbour within three lines
    begins = F.filter(p, lambda x, i: (i == 0) | (x > F.try_element_at(p, F.greatest(i, F.lit(1))) + 3))
    ends = F.filter(p, lambda x, i: (i == n - 1) | (F.coalesce(F.try_element_at(p, i + 2), x) > x + 3))
    out = out.withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_at", F.transform(lines_of(F.col("_text")), lambda q: q["at"]))
    out = out.withColumn("_spans", F.arrays_zip(F.transform(begins, lambda x: F.element_at("_at", x + 1)).alias("b"), F.transform(ends, lambda x: F.element_at("_at", x + 3)).alias("e")))
    s, count = F.col("_spans"), F.size("_spans")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), count), lambda i: slice_between("_lines", F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(s, F.greatest(i, F.lit(1)))["e"] + 1), F.when(i == count, F.size("_lines")).otherwise(F.try_element_at(s, F.least(i + 1, F.greatest(count, F.lit(1))))["b"]))))
    out = out.withColumn("n_lines", F.when(F.col("_text") == "", F.lit(0)).otherwise(F.size("_lines")).cast("long"))
    out = out.withColumn("n_removed", F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["b"] + 1)))
    out = out.withColumn("n_spans", count.cast("long")).withColumn("kept_text", F.when(count == 0, F.col("_text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, *OWN)


def slice_between(lines: str, begin: Column, end: Column) -> Column:
    return F.slice(F.col(lines), begin + 1, F.greatest(end - begin, F.lit(0)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), Shared(spark))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, u.i AS ln, parts[u.i] AS raw, trim(parts[u.i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM docs, unnest(range(1, len(parts) + 1)) AS u(i)),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos FROM lines WHERE line <> ''),
win AS (SELECT doc_id, pos, ln, lead(ln, 2) OVER w AS last_at, [line, lead(line) OVER w, lead(line, 2) OVER w] AS body FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth FROM win WHERE last_at IS NOT NULL),
hits AS (SELECT doc_id, pos, ln, last_at FROM later WHERE nth > 1),
marked AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 3 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS opens FROM hits),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked),
spans AS (SELECT doc_id, span, min(ln) AS b, max(last_at) AS e FROM grouped GROUP BY doc_id, span),
gone AS (SELECT DISTINCT doc_id, u.i AS ln FROM spans, unnest(range(b, e + 1)) AS u(i)),
kept AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.ln) AS text FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.ln = g.ln WHERE g.ln IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
nspans AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(d.parts) END AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN nspans s ON d.doc_id = s.doc_id
"""
