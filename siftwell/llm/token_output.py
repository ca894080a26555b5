"""Token ids of documents as binary files, and back.

Every text is encoded once (a byte-pair tokenizer of the tokenizers library) and gets an end
id.  Ids are numbered anew by how often they occur in the corpus, so frequent ids have small
numbers; a number takes one to four bytes, and a stream of control bytes apart from them says
how many, two bits each.  Both streams are decoded at once by table lookup in numpy.

Files: Parquet, a row a document in ascending order of doc_id: doc_id, part and at (its place:
ids before it in its part), n_tokens, control, data; beside them ``ranks`` (the id of each
number) and ``parts`` (ids before each part).  Nothing else is needed to read them.

Scale: counts are summed over the vocabulary (a bound that doesn't grow with documents) and
broadcast as ranks; documents move once, as ids, in a range partition by doc_id; running
places are counted within a part and shifted by the sums of the parts before.

Defined cases: null and empty texts are the end id alone; null ids come first, rows of one id
are ordered by their ids' hash, equal rows by their place in the table, and each is written; a
very long text is one row; an empty table gives files without rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, map_arrow, read, utf8

END = 0
#: Pieces, and stretches between spaces, that a Python worker keeps encoded: half as many of each, about 400 MB in all.
KEPT_WORDS = 1 << 21
#: Bytes of texts that are encoded at once, new stretches that the tokenizer takes at once, and bytes of the longest that is kept.
AT_ONCE, NEW, LONGEST = 8 << 20, 256, 256
FIRST_SIGN = operator.itemgetter(0)
#: The split rule of byte-level tokenizers, a fixed value: letters, digits, other signs and white space apart.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, which the standard library splits faster.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Bytes that four numbers take, by their control byte, and where each begins.
SIZES = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
TOTALS = SIZES.sum(axis=1, dtype=np.int32)
STARTS = np.concatenate([np.zeros((256, 1), np.int32), SIZES.cumsum(axis=1, dtype=np.int32)[:, :3]], axis=1)


def vocabulary(path: str | None = None) -> str:
    """The text of a tokenizer file; by default of the byte-pair tokenizer of 50,257 ids."""
    path = path or os.environ.get("SIFTWELL_TOKENIZER_JSON")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Pieces(dict):
    """Encoded pieces of texts, made when first asked for.

    At most half of ``KEPT_WORDS`` are held: when half of these are new, the older half goes,
    but pieces still in use are taken over when they are asked for again.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        if 4 * len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        return found


def alphabet() -> dict[int, str]:
    """The sign that byte-level tokenizers write for each byte: visible ones are themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def splits_bytes(said: dict) -> bool:
    """Whether a tokenizer splits texts as they are by the fixed pattern and then encodes each piece's bytes by itself."""
    split = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


@functools.lru_cache(maxsize=1)
def encoder(spec: str, kind: str) -> Callable[[str], bytes]:
    """From a text to its ids as bytes of an integer type, made once in a Python worker.

    Byte-level tokenizers split texts by a fixed pattern and encode each piece by itself, so
    pieces are encoded once and kept; texts that hold a special token, and all texts of other
    tokenizers, are encoded whole.  A piece begins at every space before another sign, so the
    stretches between such spaces are independent, and are kept too: the pattern runs once over
    each.  Texts where white space follows a space are split by the pattern as they are.
    """
    import regex
    from tokenizers import Tokenizer

    made, said = Tokenizer.from_str(spec), json.loads(spec)
    whole = lambda text: np.array(made.encode(text, add_special_tokens=False).ids, kind).tobytes()
    if not splits_bytes(said):
        return whole
    signs, model, letter = alphabet(), made.model, np.dtype(kind).char
    space = signs[ord(" ")]

    def of_piece(piece: str) -> bytes:
        shown = piece.replace(" ", space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(signs)
        found = [t.id for t in model.tokenize(shown)]
        return struct.pack(f"<{len(found)}{letter}", *found)

    ids, pieces, special = Pieces(of_piece).__getitem__, regex.compile(PATTERN).findall, [t["content"] for t in said.get("added_tokens", [])]

    def of_stretch(stretch: str) -> bytes:
        text = " " + stretch
        if stretch.isalpha():
            return of_piece(text)
        return b"".join(map(ids, ASCII.findall(text) if stretch.isascii() else pieces(text)))

    stretches = Pieces(of_stretch).__getitem__

    def encode(text: str) -> bytes:
        if any(t in text for t in special):
            return whole(text)
        first, *others = text.split(" ")
        # what is no white space here is none to the pattern either
        if not all(others) or any(map(str.isspace, map(FIRST_SIGN, others))):
            return b"".join(map(ids, pieces(text)))
        return b"".join([*map(ids, pieces(first)), *map(stretches, others)])

    return encode


class Kept:
    """Values of byte strings, made many at once for those that are new, and kept like ``Pieces``: ``most`` at most, if they are short."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int) -> None:
        self.make, self.most, self.newer, self.older = make, most, {}, {}

    def of(self, asked: list[bytes]) -> list[bytes]:
        """The values of different strings, in their order."""
        out = list(map(self.newer.get, asked))
        gone = [i for i, x in enumerate(out) if x is None]
        for i in gone:
            out[i] = self.older.get(asked[i])
        new = [i for i in gone if out[i] is None]
        for at in range(0, len(new), NEW):
            some = new[at : at + NEW]
            for i, x in zip(some, self.make([asked[i] for i in some]), strict=True):
                out[i] = x
        for i in gone:
            if len(asked[i]) <= LONGEST:
                if 2 * len(self.newer) >= self.most:
                    self.older, self.newer = self.newer, {}
                self.newer[asked[i]] = out[i]
        return out


def blank(stretch: bytes) -> bool:
    """Whether a stretch between spaces is empty or begins with white space."""
    return not stretch or (stretch[0] <= 32 or stretch[0] >= 128) and stretch[:4].decode("utf-8", "replace")[0].isspace()


@functools.lru_cache(maxsize=1)
def batch_encoder(spec: str, kind: str) -> Callable[[pa.Array], pa.Array]:
    """From texts as bytes to their ids as bytes, as ``encoder`` makes them, made once in a Python worker.

    Arrow splits all texts at spaces and joins their ids again, so that Python asks once for each
    different stretch of the texts.  New stretches are encoded many at once: each begins with a
    space and holds no other, so its first id, and no other of its ids, begins with one.
    """
    from tokenizers import Tokenizer

    made, said, encode = Tokenizer.from_str(spec), json.loads(spec), encoder(spec, kind)
    text_of = lambda held: held.decode("utf-8", "replace")
    special = [t["content"] for t in said.get("added_tokens", [])]
    if not splits_bytes(said) or any(" " in t for t in special):
        return lambda texts: pa.array([encode(text_of(t)) for t in texts.to_pylist()], pa.binary())
    vocabulary, space = made.get_vocab(), alphabet()[ord(" ")]
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[i for t, i in vocabulary.items() if t.startswith(space)]] = True

    def of_new(stretches: list[bytes]) -> list[bytes]:
        texts = [" " + text_of(s) for s in stretches]
        ids = np.array(made.encode("".join(texts), add_special_tokens=False).ids, kind)
        cuts = np.flatnonzero(begins[ids])
        if len(cuts) != len(texts) or cuts[0]:
            return list(map(encode, texts))
        held, size = ids.tobytes(), ids.itemsize
        return [held[i:j] for i, j in itertools.pairwise([*(size * cuts).tolist(), len(held)])]

    # with what ``encoder`` keeps of other texts, not much more than that keeps at most
    kept = Kept(of_new, KEPT_WORDS * 3 // 4)

    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.binary())
        split = pc.split_pattern(texts, pattern=" ")
        ends = split.offsets.to_numpy()
        firsts, flat = ends[:-1], split.flatten().dictionary_encode()
        at, stretches = flat.indices.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False)
        # texts that hold a special token, or white space behind a space, are encoded by themselves
        apart = np.fromiter(map(blank, stretches), bool, len(stretches))[at]
        apart[firsts] = False
        odd = np.logical_or.reduceat(apart, firsts)
        for t in special:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        plain = np.repeat(~odd, np.diff(ends))
        plain[firsts] = False
        used = np.zeros(len(stretches), bool)
        used[at[plain]] = True
        own = [encode(text_of(texts[i].as_py() if x else stretches[at[j]])) for i, (j, x) in enumerate(zip(firsts.tolist(), odd.tolist(), strict=True))]
        codes = pa.array([b"", *kept.of(stretches[used].tolist()), *own], pa.binary())
        places = np.where(plain, np.cumsum(used)[at], 0)
        places[firsts] = np.arange(len(codes) - len(own), len(codes))
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, codes.take(pa.array(places))), b"")

    return run


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many bytes of a column of byte strings, but of a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def id_type(spec: str) -> str:
    """The least integer type that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(spec).get_vocab().values()) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, spec: str, kind: str) -> DataFrame:
    """(doc_id, ids): the text's ids and the end id, as integers of type ``kind``."""
    sent, end = docs.sparkSession.sparkContext.broadcast(spec), np.array([END], kind).tobytes()

    def work(batches):
        encode = batch_encoder(sent.value, kind)
        for batch in (b for whole in batches for b in slices(whole, 1, AT_ONCE)):
            ids = pc.binary_join_element_wise(encode(batch.column(1)), pa.scalar(end), pa.scalar(b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    doc = dict(docs.select("doc_id").dtypes)["doc_id"]
    # the more texts at once, the fewer stretches to ask for; slices are by bytes
    return map_arrow(docs.select("doc_id", utf8("text").alias("text")), work, f"doc_id {doc}, ids binary", rows=1 << 16)


def frequencies(coded: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return map_arrow(coded.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(numbers: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes (two bits a number: its bytes less one) and data bytes of each of several runs of 32-bit numbers, of so many numbers each.

    A run's last control byte is filled up with zeros, which take a data byte each."""
    quads = -(-counts // 4)
    ends = np.cumsum(quads)
    padded = np.zeros(4 * int(quads.sum()), np.uint32)
    padded[np.arange(len(numbers)) + np.repeat(4 * (ends - quads) - (np.cumsum(counts) - counts), counts)] = numbers
    extra = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    by_four = extra.reshape(-1, 4)
    control = (by_four[:, 0] | by_four[:, 1] << 2 | by_four[:, 2] << 4 | by_four[:, 3] << 6).tobytes()
    top = int(extra.max(initial=0)) + 1
    data = padded.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :top][np.arange(top) <= extra[:, None]].tobytes()
    bytes_to = np.concatenate([[0], np.cumsum(by_four.sum(axis=1, dtype=np.int64) + 4)])
    cuts = np.concatenate([[0], ends])
    return [control[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], [data[bytes_to[i] : bytes_to[j]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of both streams."""
    c = np.frombuffer(control, np.uint8)
    totals = TOTALS[c]
    at = (np.cumsum(totals, dtype=np.int64) - totals)[:, None] + STARTS[c]
    held = np.frombuffer(data + b"\0" * 4, np.uint8)
    at, size = at.reshape(-1)[:count], SIZES[c].reshape(-1)[:count]
    words = held[at].astype(np.uint32)
    for k in range(1, size.max(initial=1)):
        words |= np.where(size > k, held[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return words


def write_tokens(docs: DataFrame, shared: Shared, name: str = "tokens", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes documents' token files; gives them as tables: (files, ranks, parts)."""
    spark = docs.sparkSession
    spec = vocabulary(tokenizer)
    kind = id_type(spec)
    coded = shared.save(encoded(docs, spec, kind), f"{name}-coded")
    # a row an id of the vocabulary
    counts = frequencies(coded, kind).collect()
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    ranks = shared.save(spark.createDataFrame(list(enumerate(order)), "rank long, id long"), f"{name}-ranks")
    table = np.zeros(max(order, default=0) + 1, np.uint32)
    table[order] = np.arange(len(order), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(table)

    def work(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            coded_ids = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in coded_ids], np.int64) // np.dtype(kind).itemsize
            controls, data = pack(sent.value[np.frombuffer(b"".join(coded_ids), kind)], sizes)
            places = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(places), pa.array(sizes), pa.array(controls, pa.binary()), pa.array(data, pa.binary())], names=["doc_id", "part", "at", "n_tokens", "control", "data"])

    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    rows = coded.withColumn("_hash", F.xxhash64("ids")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    doc = dict(rows.dtypes)["doc_id"]
    files = shared.save(map_arrow(rows, work, f"doc_id {doc}, part int, at long, n_tokens long, control binary, data binary"), name)
    shared.drop(f"{name}-coded")
    # a row a part of the files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))
    return files, ranks, shared.save(parts, f"{name}-parts")


def read_tokens(files: DataFrame, ranks: DataFrame, parts: DataFrame, use: Callable[[np.ndarray], object] | None = None, kind: str = "array<long>") -> DataFrame:
    """(doc_id, start, n_tokens, tokens) from token files; tokens are the ids, or what ``use`` makes of a document's ids, of Spark type ``kind``."""
    spark = files.sparkSession
    order = np.array([r.id for r in ranks.orderBy("rank").collect()], np.uint32)
    sent = spark.sparkContext.broadcast(order)
    made = use or (lambda ids: ids.astype(np.int64).tolist())
    held = files.join(F.broadcast(parts), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "control", "data")
    out_type = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[kind]

    def work(batches):
        for batch in batches:
            sizes, controls, data = (batch.column(k).to_pylist() for k in (2, 3, 4))
            # each run fills whole control bytes, so that the runs of a batch are one
            ends = 4 * np.cumsum([len(c) for c in controls], dtype=np.int64)
            ids = sent.value[unpack(b"".join(controls), b"".join(data), int(ends[-1]) if len(ends) else 0)]
            got = [made(ids[end - 4 * len(c) :][:n]) for end, n, c in zip(ends.tolist(), sizes, controls, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, out_type)], names=["doc_id", "start", "n_tokens", "tokens"])

    doc = dict(files.dtypes)["doc_id"]
    return map_arrow(held, work, f"doc_id {doc}, start long, n_tokens long, tokens {kind}")


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(read(spark, sf_dir, "documents"), Shared(spark))
    out = read_tokens(*files, use=lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), kind="long")
    return out.withColumnRenamed("tokens", "ids_crc32")
