"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

A window is ``LENGTH`` consecutive bytes of a text; it is a repeat if an equal window starts
earlier (smaller doc_id, or the same document further left).  Every byte inside a repeat is
removed; windows are judged on the input.

Repeats are found by merging Burrows-Wheeler transforms of shards (``bwt``): the interleave
of the shards' suffix orders is refined ``LENGTH`` times, which yields common prefixes up to
``LENGTH`` and, as runs of them, the intervals of suffixes that share a window.  Only each
interval's earliest suffix stays.  What goes before decides which texts meet in one merge:

1. The least 32-byte gram hash inside a window (its key) depends on the window's bytes alone,
   so equal windows have equal keys.  Runs of windows with one key make segments.
2. Segments whose key occurs once and holds no repeat of its own gram can hold no repeat.
3. Segments with equal key and bytes (by hash) are shards of one string: the earliest stands
   for all, and the others are repeats through and through.  This is done before any text
   moves, so a passage that a third of all documents share is one row a task.
4. The remaining segments meet by key, and their windows are told apart by the merge alone.
   It takes whole groups up to about ``MERGE_BYTES``, in shards of ``SHARD_BYTES``.
5. Where more than ``MANY`` different segments share a key, a frequent gram stands in different
   surroundings.  These segments are cut anew, with grams ordered in another way, and take the
   same steps.  Keys that are crowded even so let their windows meet by two hashes of 64 bits in
   a partial aggregate, so no merge and no task grows with the corpus.

Step 3 and the end of step 5 decide by hashes; what they decide is no longer read by the merge.

Scale: shuffles carry (key, hash, place) rows, about one for 35 bytes, then texts of
documents that take part, once, and at the end the texts with their removed stretches.

Defined cases: null text is empty; a very long text is cut into pieces of ``PIECE`` windows that
overlap, so that nothing is lost; texts shorter than a window keep all bytes; other columns are
not looked at; null doc_ids
come before all others; rows that repeat doc_id and text are one document and get the same
result; different texts of one doc_id, or without one, are documents of their own, in the order
of their hashes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt
from .common import Shared, map_arrow, read, utf8
from .shingles import mixed, prefix_sums, stretch_hashes

LENGTH, GRAM = 100, 32
#: Windows of a segment at most, and of a piece of a long text that is worked on at once.
RUN, PIECE = 128, 1 << 20
#: Different strings of a key that a merge takes, times that crowded keys are cut anew, bytes of a merge and of a shard.
MANY, LEVELS, MERGE_BYTES, SHARD_BYTES = 1024, 1, 1 << 17, 1 << 15
NULL_ID = -(1 << 63)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    pick, have = (np.minimum if least else np.maximum), 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: bytes, level: int = 0, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, hash, start, windows, again) of the segments; again: the key's gram occurs twice or more. Each level orders grams in another way."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, bool)
    raw = np.frombuffer(data, np.uint8)
    sums = prefix_sums(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = stretch_hashes(sums, at, at + gram)
    if level:
        grams = mixed(grams ^ np.uint64(level * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF))
    span = length - gram + 1
    key = sliding(grams, span, True)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(key)]]))
    if sizes.max() > RUN:
        pieces = -(-sizes // RUN)
        begins = np.repeat(begins, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.diff(np.concatenate([begins, [len(key)]]))
    # grams that are the least of some window: equal neighbours among them may repeat a window close by
    padded = np.concatenate([np.zeros(span - 1, np.uint64), key, np.zeros(span - 1, np.uint64)])
    chosen = grams[sliding(padded, span, False) == grams]
    twice = chosen[1:][chosen[1:] == chosen[:-1]]
    own = key[begins]
    return own.view(np.int64), stretch_hashes(sums, begins, begins + sizes - 1 + length).view(np.int64), begins, sizes, np.isin(own, twice)


def all_segments(pieces: DataFrame, level: int) -> DataFrame:
    """(key, hash, id, start, windows, again) of pieces (id, text), at further levels also piece of pieces (id, text, base, piece)."""
    more = ["base", "piece"] if level else []

    def cut(batches):
        for batch in batches:
            parts, rows = [], []
            bases = batch.column(2).to_pylist() if level else [0] * batch.num_rows
            for n, (text, base) in enumerate(zip(batch.column(1).to_pylist(), bases, strict=True)):
                # keys depend on a window's bytes alone, so a long text may be cut anywhere between windows
                for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                    key, code, start, size, again = segments(text[at : at + PIECE + LENGTH - 1], level)
                    if len(key):
                        parts.append((key, code, start + at + base, size, again))
                        rows.append(np.full(len(key), n, np.int64))
            if parts:
                key, code, start, size, again = (np.concatenate(x) for x in zip(*parts, strict=True))
                own = pa.array(np.concatenate(rows))
                columns = [pa.array(key), pa.array(code), batch.column(0).take(own), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int16)), pa.array(again), *([batch.column(3).take(own)] if level else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "hash", "id", "start", "windows", "again", *more[1:]])

    return map_arrow(pieces.select("id", "text", *more), cut, "key long, hash long, id long, start int, windows short, again boolean" + ", piece long" * bool(level))


def cut_out(pieces: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """(group, bytes, id, start): the strings of wanted (by, cuts), cuts: (key, start, windows)."""

    def cut(batches):
        for batch in batches:
            groups, parts, ids, starts = [], [], [], []
            for i, text, base, cuts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for c in cuts:
                    at = c["start"] - base
                    groups.append(c["key"]), parts.append(text[at : at + c["windows"] - 1 + LENGTH]), ids.append(i), starts.append(c["start"])
            if groups:
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(parts, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32())], names=["group", "bytes", "id", "start"])

    base = F.col("base") if "base" in pieces.columns else F.lit(0)
    return map_arrow(pieces.join(wanted, by).select("id", "text", base.alias("base"), "cuts"), cut, "group long, bytes binary, id long, start int")


def window_repeats(strings: DataFrame) -> DataFrame:
    """(id, start, windows): windows of strings (bytes, id, start) that start earlier elsewhere, by two hashes of 64 bits; firsts are summed before they are shuffled."""

    def cut(batches):
        import xxhash

        for batch in batches:
            codes, more, ids, starts = [], [], [], []
            for raw, i, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = np.arange(len(raw) - LENGTH + 1)
                codes.append(stretch_hashes(prefix_sums(np.frombuffer(raw, np.uint8)), at, at + LENGTH))
                more.append(np.array([xxhash.xxh3_64_intdigest(raw[k : k + LENGTH]) for k in range(len(at))], np.uint64))
                ids.append(np.full(len(at), i)), starts.append(at + start)
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (codes, more, ids)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(starts).astype(np.int32))], names=["code", "more", "id", "start"])

    rows, place = map_arrow(strings.select("bytes", "id", "start"), cut, "code long, more long, id long, start int"), F.struct("id", "start")
    firsts = rows.groupBy("code", "more").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, ["code", "more"]).where(place != F.col("place")).select("id", "start", F.lit(1).alias("windows"))


def later_windows(texts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (id, start, windows) of windows of the texts (bytes, id, start) that start earlier elsewhere among them."""
    shards, numbers, size = [[]], [[]], 0
    for n, (data, _, _) in enumerate(texts):
        if size + len(data) > SHARD_BYTES and shards[-1]:
            shards.append([]), numbers.append([])
            size = 0
        shards[-1].append(data), numbers[-1].append(n)
        size += len(data) + 1
    block, shard, text, offset = bwt.repeats(shards, LENGTH)
    which = np.array([n for own in numbers for n in own])[np.cumsum([0, *map(len, numbers[:-1])])[shard] + text]
    ids, starts = np.array([t[1] for t in texts], np.int64)[which], np.array([t[2] for t in texts], np.int64)[which] + offset
    # the earliest of each interval stays
    order = np.lexsort((starts, ids, block))
    later = order[1:][block[order[1:]] == block[order[:-1]]]
    ids, starts = ids[later], starts[later]
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    opens = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + 1)])) if len(ids) else np.zeros(0, np.int64)
    return ids[opens], starts[opens], np.diff(np.concatenate([opens, [len(ids)]]))


def merge_groups(rows: DataFrame) -> DataFrame:
    """(id, start, windows) that repeat, from rows (group, bytes, id, start). Groups, of ``MANY`` strings at most, are whole inside a task."""

    def merge(batches):
        held: list[tuple[bytes, int, int]] = []
        size, last, group = 0, None, []

        def close(group):
            # a text alone in its group may still repeat itself
            nonlocal size
            if len(group) > 1 or (group and len(group[0][0]) > LENGTH):
                held.extend(group)
                size += sum(len(g[0]) for g in group)

        def flush():
            nonlocal held, size
            (ids, starts, windows), held, size = later_windows(held) if held else [np.zeros(0, np.int64)] * 3, [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts.astype(np.int32)), pa.array(windows.astype(np.int32))], names=["id", "start", "windows"])

        for batch in batches:
            for key, data, i, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != last:
                    close(group)
                    group, last = [], key
                    if size >= MERGE_BYTES:
                        yield flush()
                group.append((data, i, start))
        close(group)
        yield flush()

    dealt = rows.repartition("group").sortWithinPartitions("group")
    return map_arrow(dealt.select("group", "bytes", "id", "start"), merge, "id long, start int, windows int", 4096)


def repeated_windows(pieces: DataFrame, shared: Shared, level: int = 0) -> DataFrame:
    """(id, start, windows): runs of windows of pieces (id, text) that also start earlier; at further levels of pieces (id, text, base, piece)."""
    by, name = ("piece" if level else "id"), lambda x: f"{x}-{level}"
    rows = all_segments(pieces, level)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key")
    keys = shared.save(keys, name("keys"))
    shared.release()
    cand = shared.save(rows.join(keys, "key"), name("segments"))
    shared.release()
    place = F.struct("id", "start", *[by] * bool(level))
    reps = cand.groupBy("key", "hash").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.max("windows").alias("windows"), F.max("again").alias("again"))
    reps = shared.save(reps, name("strings"))
    copies = reps.where("n > 1").select("key", "hash", "place")
    same = cand.join(copies, ["key", "hash"]).where(place != F.col("place")).select("id", "start", F.col("windows").cast("int").alias("windows"))
    found = shared.save(same, name("same"))
    differing = reps.groupBy("key").agg(F.count("*").alias("m"), F.max("again").alias("a")).where("m > 1 or a").select("key", (F.col("m") > MANY).alias("many"))
    differing = shared.save(differing, name("differing"))
    cuts = reps.join(differing, "key").select(F.col(f"place.{by}").alias(by), "many", F.struct("key", F.col("place.start").alias("start"), F.col("windows").cast("int").alias("windows")).alias("cut"))
    wanted = shared.save(cuts.groupBy(by, "many").agg(F.collect_list("cut").alias("cuts")), name("wanted"))
    shared.release()
    found = found.unionAll(shared.save(merge_groups(cut_out(pieces, wanted.where("not many").drop("many"), by)), name("merged")))
    if wanted.where("many").limit(1).count():
        strings = cut_out(pieces, wanted.where("many").drop("many"), by)
        if level < LEVELS:
            strings = shared.save(strings.select("id", F.col("bytes").alias("text"), F.col("start").alias("base")).withColumn("piece", F.monotonically_increasing_id()), name("crowded"))
            found = found.unionAll(repeated_windows(strings, shared, level + 1))
        else:
            found = found.unionAll(shared.save(window_repeats(strings), name("windows")))
    for x in ("keys", "segments", "strings", "differing", "wanted", "crowded"):
        shared.drop(name(x))
    shared.release()
    return found


def numbered(rows: DataFrame, shared: Shared) -> DataFrame:
    """rows (doc_id, text, id) with new ids: equal for rows of equal id and text alone, and ascending by id, then by text hash.

    Range partitions follow each other in that order, and so do numbers given inside them; texts of one id may lie in several partitions."""
    code = F.xxhash64("text")
    texts = shared.save(rows.select("id", code.alias("code")).distinct(), "texts")
    order = texts.repartitionByRange("id", "code").sortWithinPartitions("id", "code").select("id", "code", F.monotonically_increasing_id().alias("number"))
    order = shared.save(order, "order")
    return rows.withColumn("code", code).join(order, ["id", "code"]).select("doc_id", "text", F.col("number").alias("id"))


def dedup_substrings(docs: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_bytes, kept_sha256) of docs (doc_id, text); spans: removed (from, to) stretches."""
    all_rows = docs.select("doc_id", utf8("text").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    part = all_rows.select("id", "text")
    if all_rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        all_rows = numbered(all_rows, shared)
        part = shared.save(all_rows.groupBy("id").agg(F.first("text").alias("text")), "part")
    runs = repeated_windows(part, shared).groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    both = all_rows.join(runs, F.col("id") == F.col("_id"), "left").select("doc_id", "text", "runs")

    def remove(batches):
        for batch in batches:
            n_bytes, gone, spans, kept, digests = [], [], [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((r["start"], r["start"] + r["windows"] - 1 + LENGTH) for r in own or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *[x for span in merged for x in span], len(text)]
                left = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if merged else text
                n_bytes.append(len(text)), gone.append(len(text) - len(left)), kept.append(left), digests.append(hashlib.sha256(left).hexdigest())
                spans.append([{"from": a, "to": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_bytes", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(both, remove, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<`from`: int, `to`: int>>, kept_bytes binary, kept_sha256 string")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), Shared(spark))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
