"""Merkle manifest, token files and hard negatives against plain Python."""

import hashlib
import math
import zlib

import edge
import numpy as np
import pyarrow as pa
import pytest
from compare import SMALL, same
from pyspark.sql import functions as F

from siftwell.llm import hard_negatives, merkle_manifest, queries, token_output


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest"])
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])


# --- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(digests):
    """The top of a tree, and each leaf's siblings by level: [(left, right)]."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i - i % 8 : i - i % 8 + 8]
            ways[leaf].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[leaf] = i // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], ways


def brute_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text), in order within a language."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    tops, ways = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[lang], found = climb([leaf(r) for r in own])
        ways[lang] = list(zip(own, found, strict=True))
    root, above = climb([tops[x] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        for r, way in ways[lang]:
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4]
            at = leaf((*r[:4], lower))
            for left, right in [*way, *up]:
                at = sha(left + at + right)
            out.append((r[0], leaf(r), tops[lang], root, sha("".join(a + b for a, b in [*way, *up])), at, at == root))
    return sorted(out, key=str)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, level string"


def proved(spark, shared, rows, upper):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], MANIFEST)
    made = merkle_manifest.manifest(shared.save(merkle_manifest.leaves_of(docs), "digests"), shared)
    out = merkle_manifest.proofs(made, shared, upper).withColumn("end", merkle_manifest.fold(F.col("own.now"), F.col("steps"))).collect()
    got = [(r.own.doc_id, r.own.leaf, r.subroot, r.root, sha("".join(s.left + s.right for s in r.steps)), r.end, r.end == r.root) for r in out]
    return sorted(got, key=str)


@pytest.mark.parametrize("upper", [0, 3, 1024])
def test_proofs_fold_to_the_root(spark, shared, upper):
    rows = [(i, f"s{i % 3}" if i % 5 else None, "en", i, f"Text {i} É") for i in range(700)]
    rows += [(1000 + i, "s", "de", None, "AbC" if i % 2 else None) for i in range(9)] + [(2000, None, "fr", 3, ""), (2001, "s", "ß", 1, "x" * 70000)]
    rows += [(3000 + i, None, None, 0, "NULL lang") for i in range(65)] + [(3000, "s", "", 1, "empty lang")]
    rows += [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (5, "s2", "en", 5, "same id"), (6, "s0", "en", 6, "Text 6 É")]
    got = proved(spark, shared, rows, upper)
    assert got == brute_manifest(rows)
    assert {v for *_, v in got} == {True, False}


def test_many_groups(spark, shared):
    rows = [(i, "s", f"lang{i % 90}", i, "Text") for i in range(200)]
    assert proved(spark, shared, rows, 1024) == brute_manifest(rows)


def test_single_and_empty(spark, shared):
    one = [(3, "s", "en", 1, "Only")]
    assert proved(spark, shared, one, 1024) == brute_manifest(one)
    from siftwell.llm.common import Shared

    assert proved(spark, Shared(spark), [], 1024) == []


def test_equal_rows_each_have_a_proof(spark, shared):
    rows = [(7, "s", "en", 1, "Same")] * 40 + [(8, "s", "en", 1, "Other")] * 3
    got = proved(spark, shared, rows, 2)
    assert len(got) == 43 and sorted(got, key=str) == brute_manifest(rows)


# --- token files


@pytest.mark.parametrize("numbers", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1001)), [2**31] * 5])
def test_streams_round_trip(numbers):
    runs = [[], numbers, [7], numbers[::-1], numbers[:2]]
    counts = np.array([len(r) for r in runs])
    controls, data = token_output.pack(np.array([n for r in runs for n in r], np.uint32), counts)
    for r, c, d in zip(runs, controls, data, strict=True):
        assert len(c) == math.ceil(len(r) / 4)
        assert len(d) == sum(1 + (n > 0xFF) + (n > 0xFFFF) + (n > 0xFFFFFF) for n in r) + -len(r) % 4
        assert token_output.unpack(c, d, len(r)).tolist() == r


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_str(token_output.vocabulary()).encode(text or "", add_special_tokens=False).ids, 0]


def test_files_hold_every_documents_ids(spark, shared, edges):
    long = spark.createDataFrame([(99, edge.prose(3, 9000) + " <|endoftext|> tail\r\n　x  "), (98, "! ! it's 12 漢字\n\n\t")], "doc_id long, text string")
    docs = edges.select("doc_id", "text", "rank", "key").unionByName(long, allowMissingColumns=True)
    files, ranks, parts = token_output.write_tokens(docs.repartition(5), shared)
    out = token_output.read_tokens(files, ranks, parts).orderBy("start").collect()
    want = [(r.doc_id, plain_ids(r.text)) for r in docs.collect()]
    assert sorted(((str(r.doc_id), r.tokens) for r in out)) == sorted((str(d), ids) for d, ids in want)
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out]])[:-1].tolist()
    assert [r.doc_id for r in out] == sorted((d for d, _ in want), key=lambda d: (d is not None, d or 0))
    counts = {}
    for _, ids in want:
        for i in ids:
            counts[i] = counts.get(i, 0) + 1
    assert [r.id for r in ranks.orderBy("rank").collect()] == sorted(counts, key=lambda i: (-counts[i], i))


def test_pieces_kept_by_a_worker_are_bounded(monkeypatch):
    monkeypatch.setattr(token_output, "KEPT_WORDS", 10)
    token_output.encoder.cache_clear()
    encode = token_output.encoder(token_output.vocabulary(), "<u4")
    texts = [*(edge.prose(i, 40) for i in range(8)), "", "\x1c \x85\u3000x ²½ 'll'LL don't\r\n \t", "🙂漢字ß é", "<|endoftext|>a", " \n\n  it's\t\x0b \x1c\x1f 12a_ !?'re  ", "   "]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_ids(text)[:-1]
    token_output.encoder.cache_clear()
    held = token_output.Pieces(str.encode)
    for i in range(100):
        assert held[str(i % 17)] == str(i % 17).encode()
        assert len(held) + len(held.older) <= 10


def test_stretches_between_spaces_are_split_once(monkeypatch):
    """The pattern runs over each different stretch once, not over every text; white space behind a space is split with its text."""
    runs = []

    class Counted:
        def __init__(self, found):
            self.found = found

        def findall(self, text):
            runs.append(text)
            return self.found.findall(text)

    import regex
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "ASCII", Counted(token_output.ASCII))
    made = regex.compile
    monkeypatch.setattr(regex, "compile", lambda pattern: Counted(made(pattern)))
    token_output.encoder.cache_clear()
    encode = token_output.encoder(token_output.vocabulary(), "<u2")
    texts = [f"über {i} isn't über, isn't\nso.\n\nover isn't über," for i in range(12)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u2").tolist() == plain_ids(text)[:-1]
    assert sum(map(len, runs)) < len("".join(texts)) / 2
    signs, seed = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u200b'stre,.1\u00b2\u0663\u00e9\u00dfab\u4e2d\x00-\u0301    ", 7
    plain = Tokenizer.from_str(token_output.vocabulary())
    for _ in range(2000):
        text = ""
        for _ in range(seed % 13):
            seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
            text += signs[(seed >> 33) % len(signs)]
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        seed ^= seed >> 29
        assert np.frombuffer(encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    token_output.encoder.cache_clear()


def test_a_batch_asks_once_for_each_stretch(monkeypatch):
    """Texts are encoded many at once: a stretch that all of them hold is asked for once, new ones go to the tokenizer together, and ids are those of plain encoding."""
    asked = []
    monkeypatch.setattr(token_output, "NEW", 7)
    monkeypatch.setattr(token_output, "KEPT_WORDS", 40)
    monkeypatch.setattr(token_output, "LONGEST", 9)
    monkeypatch.setattr(token_output.Kept, "of", lambda self, some, of=token_output.Kept.of: asked.append(some) or of(self, some))
    token_output.encoder.cache_clear()
    token_output.batch_encoder.cache_clear()
    encode = token_output.batch_encoder(token_output.vocabulary(), "<u2")
    odd = ["", " ", "a", " a", "a ", "a  b", "  a b", "a \n b", "a \u3000b c", "a \x85b", "a\n b\n\n c", "12 ab12, it's 🙂 ²½ ß", "x<|endoftext|> y z", "\x1cq \x1fw e", "longer-than-nine-bytes d"]
    texts = [*(edge.prose(i % 5, 60) for i in range(20)), *odd]
    ids = [np.frombuffer(x, "<u2").tolist() for _ in range(2) for x in encode(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()]
    assert ids == 2 * [plain_ids(t)[:-1] for t in texts]
    assert len(asked) == 2 and all(len(some) == len(set(some)) for some in asked)
    assert encode(pa.array([b"a \xff\xc3 b\xe2\x82 c"], pa.binary())).to_pylist() == [np.array(plain_ids(b"a \xff\xc3 b\xe2\x82 c".decode("utf-8", "replace"))[:-1], "<u2").tobytes()]
    token_output.batch_encoder.cache_clear()
    token_output.encoder.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([b"abc", b"", b"defgh" * 9, b"i", b"jk"])], names=["t"])
    assert [x.num_rows for x in token_output.slices(batch, 0, 4)] == [2, 1, 2]


def test_no_documents_no_tokens(spark, shared):
    assert token_output.read_tokens(*token_output.write_tokens(edge.table(spark, []), shared)).count() == 0


def test_token_query_equals_plain_encoding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    start, want = 0, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = np.array(plain_ids(r.text), "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = queries.QUERIES["op13_token_output"](spark, SMALL).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


# --- hard negatives


def brute_negatives(rows, every=100):
    whole = [(i, label, [min(2**26, max(-(2**26), math.floor(256 * float(x)))) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: (i is None, i or 0)
    anchors, out = {(i, label, tuple(v)) for i, label, v in whole if i is not None and i % every == 0}, []
    for i, label, v in anchors:
        scored = sorted(((-dot(v, w), last(j), j, other) for j, other, w in whole if j != i), key=lambda x: x[:2])
        for s, _, p, other in [x for x in scored if x[3] == label][:5]:
            found = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, p, k, x[2], -s, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out, key=str)


def vector_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, 6))
    rows = [(i, int(k), [float(np.float32(x)) for x in centre[k] + rng.normal(size=6) * 0.7]) for i, k in enumerate(rng.integers(0, 3, n))]
    rows += [(2000 + i, i % 4, [1.0, 0.5, 0.25, -0.5, 0.0, 1.0]) for i in range(120)]  # equal vectors
    rows += [(3000, None, [1.0] * 6), (3001, 1, None), (3002, 1, [1.0, None]), (3003, 2, [float("nan")] * 6), (3004, 2, [float("inf")] * 6), (3005, 1, []), (3006, 2, [2.0, 1.0]), (None, 1, [1.5] * 6), (3100, 0, [-1.0] * 6), (3200, 9, [1.0] * 6), (3300, 1, [3e9] * 6), (100, 2, [0.5] * 6)]
    return rows + rows[100:110] + rows[200:201]


@pytest.mark.parametrize(("block", "slot_rows"), [(4096, 1_000_000), (2, 7)])
def test_negatives(spark, shared, block, slot_rows):
    rows = vector_rows(400)
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, label int, embedding array<double>, id string, rank int")
    out = hard_negatives.mine(hard_negatives.vectors(df, F.col("label")), F.col("id") % 100 == 0, shared, block, slot_rows)
    assert sorted((tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str) == brute_negatives(rows)


def test_scores_stay_exact():
    a = np.array([[2**26, -(2**26), 3]] * 2, np.int64)
    b = np.array([[2**26 - 1, 2**26 - 5, 7]], np.int64)
    assert hard_negatives.scores(a, b)[0, 0] == 2**26 * (2**26 - 1) - 2**26 * (2**26 - 5) + 21


def test_no_rows_no_negatives(spark, shared):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.vectors(df, F.col("label")), F.col("id") % 100 == 0, shared).count() == 0
