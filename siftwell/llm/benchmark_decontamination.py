"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and texts are normalised alike: A-Z lower-cased, words are runs of ASCII
letters, digits and non-ASCII characters, joined by single spaces.  Every run of ten words
of an item is a window (items of fewer words are one window).  One automaton over all
windows scans each normalised text once; the places of its matches are mapped back to word
numbers and to byte offsets of the original text.

Scale: a test set has a fixed size, which is checked: items are dealt into blocks of at
most ``BLOCK_WORDS`` words, each block is broadcast and scanned in turn, so any number of
items works with bounded memory.  With one block (the usual case) there is no shuffle.

Defined cases: null or empty texts have no words and no hits; a very long text is scanned whole; null or wordless items have
no windows; items that repeat an id count once; null item ids read as empty; repeated rows
of one doc_id and text count as one document where blocks are merged and get the same
verdict; an empty table of either kind gives clean documents or no rows; columns named
like ours are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read, utf8

#: Words of items to a block. An automaton takes about 3 KB a word in each Python worker.
WINDOW, BLOCK_WORDS = 10, 100_000
OWN = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans")
#: Bytes of words stay (A-Z lowered), all others become spaces.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SPAN = "array<struct<first_word: int, last_word: int, from_byte: int, to_byte: int>>"


def item_windows(items: list[tuple[str, bytes]], width: int = WINDOW) -> dict[bytes, tuple[int, set[str]]]:
    """Each window, with spaces around it, with its number of words and the items that hold it."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = text.translate(NORMAL).split()
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", (size, set()))[1].add(item)
    return found


def automaton(windows: dict[bytes, tuple[int, set[str]]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for key, (size, items) in windows.items():
        made.add_word(key.decode("latin-1"), (size, items))
    made.make_automaton()
    return made


def hits(data: bytes, machine) -> tuple[int, list[tuple[int, int, int, int]], set[str]]:
    """Words of the text, merged spans of hit words (with byte offsets), items found."""
    flat = data.translate(NORMAL)
    words = flat.split()
    if not words or not len(machine):
        return len(words), [], set()
    text = b" " + b" ".join(words) + b" "
    found, items = [], set()
    for end, (size, own) in machine.iter(text.decode("latin-1")):
        found.append((end, size))
        items |= own
    if not found:
        return len(words), [], items
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    last = np.searchsorted(spaces, [e for e, _ in found]) - 1
    first = last - np.array([s for _, s in found]) + 1
    solid = np.concatenate([[False], np.frombuffer(flat, np.uint8) != 0x20, [False]])
    begins, ends = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    merged: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(words), [(a, b, int(begins[a]), int(ends[b])) for a, b in merged], items


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``most`` words, each collected when its turn comes."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // (6 * most)))
    deal = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
    for b in range(count):
        yield [(r.item, bytes(r.text)) for r in deal.where(F.col("block") == b).select("item", "text").collect()]


def scan(docs: DataFrame, windows: dict[bytes, tuple[int, set[str]]]) -> DataFrame:
    """docs with n_words, spans (merged stretches of hit words) and items (sorted)."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def look(batches):
        machine = automaton(sent.value)
        for batch in batches:
            got = [hits(data, machine) for data in batch.column(batch.num_columns - 1).to_pylist()]
            names = ("first_word", "last_word", "from_byte", "to_byte")
            spans = [[dict(zip(names, s, strict=True)) for s in spans] for _, spans, _ in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _, _ in got], pa.int64()), pa.array(spans, pa.list_(pa.struct([(x, pa.int32()) for x in names]))), pa.array([sorted(i) for _, _, i in got], pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "n_words long", f"spans {SPAN}", "items array<string>"])
    return map_arrow(docs.withColumn("_bytes", utf8("text")), look, schema)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit (words inside occurrences), n_items, items, items_sha256, contaminated and spans."""
    docs = docs.drop(*OWN)
    dealt = blocks(items, block_words)
    out = scan(docs, item_windows(next(dealt), width))
    key, more = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key")], None
    for block in dealt:
        part = scan(docs.select("doc_id", "text"), item_windows(block, width)).where("size(spans) > 0").select(*key, "spans", "items")
        more = part if more is None else more.unionAll(part)
    if more is not None:
        more = more.groupBy("doc_id", "_key").agg(F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("items")).alias("_items")).withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_k")
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_k")), "left")
        out = out.withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("_spans", F.array().cast(SPAN))))).withColumn("items", F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first_word"], s["last_word"])))))
    out = out.withColumn("n_hit", F.when(F.size("spans") > 0, hit).otherwise(0).cast("long")).withColumn("items", F.array_sort("items")).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).withColumn("contaminated", F.col("n_hit") > 0)
    return out.select(*docs.columns, *OWN)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS m FROM items WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item, least(10, len(w)) AS m, w[u.i : u.i + least(10, len(w)) - 1] AS win FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
dwin AS (SELECT doc_id, m, u.i AS pos, w[u.i : u.i + m - 1] AS win FROM words, sizes, unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
found AS (SELECT d.doc_id, d.pos, d.m, i.item FROM dwin d JOIN iwin i ON d.m = i.m AND d.win = i.win),
hit AS (SELECT doc_id, count(DISTINCT u.i) AS n FROM found, unnest(range(pos, pos + m)) AS u(i) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items, sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON w.doc_id = h.doc_id LEFT JOIN own o ON w.doc_id = o.doc_id
"""
