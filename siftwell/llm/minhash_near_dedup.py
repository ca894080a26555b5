"""Near-duplicate documents by b-bit MinHash: banding finds candidates, packed low bits estimate them.

A document's set holds its distinct shingles of five words.  ``HASHES`` minima are taken;
runs of ``ROWS`` of them make band keys; the low two bits of every minimum are packed into
a signature.  Documents that share a band key are candidates.  Their similarity is
estimated from the number of agreeing packed minima, corrected for chance agreement:
J = (p - 1/4) / (1 - 1/4).  Estimates far below the threshold (``SLACK``) are dropped; all
others are confirmed on the full sets.  Links give components; the smallest doc_id names
each.

No group is expanded into all of its pairs.  Documents with equal sets are one node.  Then:

1. Each band has a centre, its node of most company over all bands (the text that copies
   were made from meets more copies than they meet one another); each node is confirmed
   against the likeliest of its bands' centres.
2. Bands whose nodes still belong to different components are open.  Their signatures meet
   in memory; what leaves a band is a forest over its components of the likeliest pairs, one
   pair a component at most, and these are confirmed.
3. In bands that are open even so, nodes with a likely partner in another component meet
   with their texts, and sets are compared until no link between components is left.

A band of more than ``BLOCK`` nodes that stays open is not compared as a whole.  Its nodes
meet again by their rarest shingles: two sets of similarity s share one of the first
n - ceil(s n) + 1 shingles in any common order, so this loses no link, and with frequent
shingles last in the order few nodes meet.  Only if more than ``BLOCK`` nodes share a rare
shingle, they are dealt into blocks, and blocks meet in pairs.  Nothing is capped.

Chance of missing a pair of similarity s by banding: (1 - s^6)^64, 3.6e-6 at 0.75 and less
above; by the estimate: five standard deviations.

Scale: shuffles carry band keys, signatures and ids.  The texts of candidates are joined out
of the corpus once; then a text moves once for each pair to confirm, and a centre's text once
for ``MEMBERS`` of its members.  The compared rows of a task are held one band at a time.

Defined cases: texts without words are empty sets, link with nothing and are kept; texts of
fewer than five words have one shingle, the whole sequence; very long texts are whole (a task
holds the sets of the two texts it compares); rows that share a doc_id are one document and
share a component, also if their texts differ; a row with a null doc_id links with nothing
and is kept, its component_id null; an empty table gives an empty result; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, map_arrow, read, utf8
from .components import relabelled
from .shingles import alike, mixed, shingle_set

ROWS, BANDS = 6, 64
HASHES = ROWS * BANDS
PERCENT = 75
#: Low two bits of 384 minima: 12 words of 64 bits.
LANES = HASHES * 2 // 64
#: Five standard deviations of the estimate at the threshold.
SLACK = 0.133
#: Nodes, and shingles of nodes, of a band that meet in memory; members that one copy of a centre serves.
BLOCK, WEIGHT, MEMBERS = 2048, 1 << 20, 512
#: Nodes of wide bands whose shingles are counted to order shingles by frequency, and the frequent shingles kept. Any order loses nothing.
SAMPLE, FREQUENT = 2048, 1 << 16

_rng = np.random.default_rng(11)
TIMES = _rng.integers(0, 1 << 31, (HASHES, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = _rng.integers(0, 1 << 32, (HASHES, 1)).astype(np.uint32)
BLEND = _rng.integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The HASHES minima of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    room = np.empty((HASHES, min(512, len(x))), np.uint32)
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        out = room[:, : len(part)]
        np.multiply(TIMES, part, out=out)
        np.add(out, PLUS, out=out)
        # the low bits of products are weak; fold the high ones in
        np.bitwise_xor(out, out >> np.uint32(15), out=out)
        np.minimum(least, out.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * BLEND).sum(1, dtype=np.uint64) + STEP).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a word."""
    low = (mixed(least.astype(np.uint64)) & np.uint64(3)).reshape(LANES, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima agree in their low bits, row by row (uint64 lanes)."""
    x = a ^ b
    return HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int32)


def estimate(agree):
    """Similarity from the share of agreeing low bits, corrected for agreement by chance (one in four)."""
    return (agree / HASHES - 0.25) / 0.75


def sql_estimate(a: Column, b: Column) -> Column:
    ones = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(0x5555555555555555)))), F.lit(0), lambda s, x: s + x)
    return estimate(F.lit(HASHES) - ones)


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set, bands, signature); set, a 128-bit key of the set, is null for empty ones."""

    def sign(batches):
        for batch in batches:
            n, keys, bands, signed = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text)
                n.append(len(shingles))
                if len(shingles):
                    least = minima(shingles)
                    keys.append(set_key(shingles))
                    bands.append(band_keys(least))
                    signed.append(packed(least))
                else:
                    keys.append(None), bands.append(None), signed.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set", "bands", "signature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), sign, "doc_id long, n_shingles long, set binary, bands array<long>, signature array<long>")


def common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share: sums of products of 0/1 matrices, ``width`` elements at a time."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # elements of one set only are shared by none
    number = np.cumsum(times > 1) - 1
    many = times[element] > 1
    who, element = who[many], number[element[many]]
    order = np.argsort(element, kind="stable")
    who, element = who[order], element[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        a, b = np.searchsorted(element, (start, start + width))
        held = np.zeros((len(sets), width), np.float32)
        held[who[a:b], element[a:b] - start] = 1.0
        out += held @ held.T
    return out.astype(np.int64)


#: The estimate, as agreeing minima, from which a pair is likely.
FLOOR = int(np.floor(HASHES * (0.25 + 0.75 * (PERCENT / 100 - SLACK))))


def whole_groups(batches, rows: int = 8192):
    """Tables of whole groups (columns key, lo, hi, sorted), several small ones together; with each the number of every row's group."""
    held: list[pa.RecordBatch] = []
    count = weight = 0

    def grouped(table):
        keys = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
        fresh = np.zeros(table.num_rows, np.int64)
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
        return np.cumsum(fresh)

    for batch in batches:
        held.append(batch)
        count, weight = count + batch.num_rows, weight + int(batch.column("size").to_numpy().sum())
        if count >= rows or weight >= WEIGHT:
            table = pa.Table.from_batches(held).combine_chunks()
            number = grouped(table)
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield table.slice(0, last), number[:last]
            held = table.slice(last).to_batches()
            # what stays is one open group; the next look at it waits for as much again
            count, weight = 0, 0
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, grouped(table)


def likely(table: pa.Table, number: np.ndarray) -> np.ndarray:
    """(agreeing, i, j) of rows of one group with different labels whose estimate and sizes allow a link."""
    label, size, block, lo, hi = (table.column(c).to_numpy() for c in ("label", "size", "block", "lo", "hi"))
    lanes = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, LANES).view(np.uint64)
    found = [np.zeros((0, 3), np.int64)]
    for d in range(1, len(number)):
        i = np.flatnonzero(number[d:] == number[:-d])
        if not len(i):
            break
        small, large = np.minimum(size[i], size[i + d]), np.maximum(size[i], size[i + d])
        i = i[(label[i] != label[i + d]) & (100 * small >= PERCENT * large) & ((lo[i] == hi[i]) | (block[i] != block[i + d]))]
        agree = agreeing(lanes[i], lanes[i + d])
        fits = agree >= FLOOR
        if fits.any():
            found.append(np.stack([agree[fits], i[fits], i[fits] + d], 1))
    return np.concatenate(found)


class Forest:
    """Union-find over the labels of one group."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = x = self.root.get(self.root[x], self.root[x])
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.top(x), self.top(y)
        if p != q:
            self.root[max(p, q)] = min(p, q)
        return p != q


def in_groups(rows: DataFrame, work, schema: str) -> DataFrame:
    """work on whole groups (key, lo, hi) of rows, in a stream over sorted partitions."""

    def run(batches):
        for table, number in whole_groups(batches):
            made = work(table, number)
            if made.num_rows:
                yield from made.to_batches()

    return map_arrow(rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"), run, schema, 1024)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def likeliest(table: pa.Table, number: np.ndarray) -> pa.Table:
    """(a, b): of each group a forest over its labels, of the likeliest pairs."""
    node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
    pairs, out, forests = likely(table, number), [], {}
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
        if forests.setdefault(number[i], Forest()).join(int(label[i]), int(label[j])):
            out.append(sorted((int(node[i]), int(node[j]))))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)


def with_partner(table: pa.Table, number: np.ndarray) -> pa.Table:
    """(key, node) of rows that have a likely partner."""
    pairs = likely(table, number)
    return table.take(np.unique(pairs[:, 1:])).select(["key", "node"])


def linked_pairs(table: pa.Table, number: np.ndarray) -> pa.Table:
    """(a, b): of each group a forest over its labels, of pairs whose full sets (of the column text) are alike."""
    node, label, text = table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("text")
    pairs, out = likely(table, number), []
    for group in np.unique(number[pairs[:, 1]]):
        own = pairs[number[pairs[:, 1]] == group]
        rows = np.unique(own[:, 1:])
        sets = {int(i): shingle_set(text[int(i)].as_py()) for i in rows}
        if many := len(own) > 8 * len(rows):
            shared, at = common(list(sets.values())), {int(i): k for k, i in enumerate(rows)}
        forest = Forest()
        for _, i, j in own[np.argsort(-own[:, 0], kind="stable")].tolist():
            x, y = int(label[i]), int(label[j])
            if forest.top(x) == forest.top(y):
                continue
            if many:
                both = int(shared[at[i], at[j]])
                same = 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both)
            else:
                same = alike(sets[i], sets[j], PERCENT)
            if same:
                forest.join(x, y)
                out.append(sorted((int(node[i]), int(node[j]))))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of pairs (member, centre) whose full sets are alike. A centre's text is sent once for some ``MEMBERS`` members."""
    salts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    dealt = pairs.join(salts, "centre").select("member", "centre", F.pmod(F.xxhash64("member"), "salts").alias("salt"))
    members = dealt.join(texts.select(F.col("node").alias("member"), "text"), "member").select("centre", "salt", F.col("member").alias("node"), "text")
    centres = dealt.select("centre", "salt").distinct().join(texts.select(F.col("node").alias("centre"), "text"), "centre").select("centre", "salt", F.col("centre").alias("node"), "text")
    rows = members.unionAll(centres).withColumn("other", F.col("node") != F.col("centre")).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "other")

    def look(batches):
        at, middle = None, None
        for batch in batches:
            found = []
            for centre, node, text in zip(*[batch.column(c).to_pylist() for c in ("centre", "node", "text")], strict=True):
                if node == centre:
                    at, middle = centre, shingle_set(text)
                elif at == centre and alike(shingle_set(text), middle, PERCENT):
                    found.append(sorted((node, centre)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], schema=PAIR)

    return map_arrow(rows.select("centre", "node", "text"), look, "a long, b long", 64)


def mixed_keys(rows: DataFrame) -> DataFrame:
    """(key, n) of the keys of rows (key, node, label) that hold several labels."""
    return rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("n")).where("_lo != _hi").select("key", "n")


def rare_keys(wide: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, node, label): nodes (node, label) by their rarest shingles; nodes whose sets are alike share a key."""
    some = wide.select("node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE)

    def every(batches):
        for batch in batches:
            made = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64))], names=["key"])

    counts = map_arrow(texts.join(some, "node").select("text"), every, "key long", 64).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE // 64)
    often = np.sort(np.array([r.key for r in counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], np.int64).view(np.uint64))

    def rarest(batches):
        for batch in batches:
            keys, sizes = [np.zeros(0, np.uint64)], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text)
                order = np.argsort(np.isin(own, often), kind="stable")
                keys.append(own[order[: len(own) - -(-PERCENT * len(own) // 100) + 1]])
                sizes.append(len(keys[-1]))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "node", "label"])

    return map_arrow(texts.join(wide, "node").select("node", "label", "text"), rarest, "key long, node long, label long", 64)


def dealt(rows: DataFrame, most: Column) -> DataFrame:
    """rows (key, ...) with lo, hi and block: whole groups are one block; of ``most`` blocks each pair is a group."""
    rows = rows.withColumn("_blocks", most.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_blocks", "_other")


def open_rows(members: DataFrame, labels: DataFrame, facts: DataFrame, texts: DataFrame, shared: Shared, name: str) -> DataFrame:
    """(key, lo, hi, block, node, label, size, signature) of the nodes of open bands, wide ones by their rarest shingles."""
    labelled = members.join(labels, "node").select("key", "node", "label")
    found = shared.save(labelled.join(mixed_keys(labelled), "key"), f"{name}-open")
    rows = found.where(F.col("n") <= BLOCK)
    wide = found.where(F.col("n") > BLOCK).select("node", "label").distinct()
    if wide.limit(1).count():
        rare = shared.save(rare_keys(shared.save(wide, f"{name}-wide"), texts), f"{name}-rare")
        rows = rows.unionAll(rare.join(mixed_keys(rare), "key").select("key", "node", "label", "n"))
    return dealt(rows.join(facts, "node"), F.ceil(F.col("n") / BLOCK)).select("key", "lo", "hi", "block", "node", "label", "size", "signature")


def near_duplicates(docs: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text)."""
    signed = shared.save(signatures(docs), "signed")
    full = signed.where("set is not null and doc_id is not null")
    nodes = full.groupBy("set").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    nodes = shared.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    sizes = shared.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = shared.save(rows.join(sizes, "key").select("key", "node", "n"), "members")
    company = shared.save(members.groupBy("node").agg(F.sum("n").alias("met")), "company")
    facts = shared.save(nodes.join(company, "node", "left_semi").select("node", "set", "first", "size", "signature"), "facts")
    sig = facts.select("node", "size", "signature")

    # the texts of candidates; a doc_id may hold several texts, the set tells which is meant
    wanted = docs.select(F.col("doc_id").cast("long").alias("first"), utf8("text").alias("text")).join(facts.select("node", "first", "set"), "first").select("node", "set", "text")

    def meant(batches):
        for batch in batches:
            right = [set_key(shingle_set(t)) == s for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(right, pa.bool_())).select(["node", "text"])

    texts = shared.save(map_arrow(wanted, meant, "node long, text binary"), "texts")

    # sets of one doc_id belong together
    several = full.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo != hi").select("doc_id")
    several = shared.save(full.join(several, "doc_id").select("doc_id", "set").distinct().join(nodes.select("set", "node"), "set").select("doc_id", "node"), "several")
    own = several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a != node").select("a", F.col("node").alias("b"))

    # each node with the likeliest of its bands' centres
    firsts = members.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("centre"))
    offers = members.join(firsts, "key").where("node != centre").select("node", "centre").distinct()
    offers = offers.join(sig, "node").join(sig.select(F.col("node").alias("centre"), F.col("signature").alias("other")), "centre")
    offers = offers.select("node", "centre", sql_estimate(F.col("signature"), F.col("other")).alias("estimate")).where(F.col("estimate") >= PERCENT / 100 - SLACK)
    pairs = shared.save(offers.groupBy("node").agg(F.max_by("centre", F.struct("estimate", -F.col("centre"))).alias("centre")).withColumnRenamed("node", "member"), "pairs")
    links = shared.save(confirmed(pairs, texts).unionAll(own), "links")
    singles = company.select("node").unionAll(several.select("node")).distinct().select("node", F.col("node").alias("label"))
    labels = relabelled(singles, links, shared, "labels-1")

    # the likeliest pairs between components
    pairs = shared.save(in_groups(open_rows(members, labels, sig, texts, shared, "forest"), likeliest, "a long, b long").distinct(), "likeliest")
    links = shared.save(confirmed(pairs.select(F.col("a").alias("member"), F.col("b").alias("centre")), texts), "links-2")
    labels = relabelled(labels, links, shared, "labels-2")

    # whatever is left, on full sets
    rows = shared.save(open_rows(members, labels, sig, texts, shared, "rest"), "rest")
    left = shared.save(in_groups(rows, with_partner, "key long, node long").distinct(), "left")
    weights = left.join(sig.select("node", "size"), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / WEIGHT))
    rows = dealt(left.join(weights, "key").join(labels, "node").join(sig, "node"), blocks).join(texts, "node")
    links = shared.save(in_groups(rows.select("key", "lo", "hi", "block", "node", "label", "size", "signature", "text"), linked_pairs, "a long, b long").distinct(), "links-3")
    labels = relabelled(labels, links, shared, "labels-3")

    named = nodes.select("set", "first", "node").join(labels, "node", "left").select("set", "first", F.coalesce("label", "node").alias("label"))
    least = shared.save(named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("label", "component_id"), "least")
    named = shared.save(named.join(least, "label", "left").select("set", F.coalesce("component_id", "first").alias("component_id")), "named")
    for name in ("nodes", "sizes", "members", "company", "facts", "texts", "several", "pairs", "links", "likeliest", "links-2", "rest", "left", "links-3", "labels-3", "least", "forest-open", "rest-open"):
        shared.drop(name)
    out = signed.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), Shared(spark))
