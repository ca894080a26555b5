"""LM scoring with a hidden Markov model, trained by Baum-Welch over all partitions.

Tokens are words with A-Z lower-cased, then one end token a text.  The states of the model
emit *classes* of tokens: each frequent word (``HEAD`` at most) and the end are classes of
their own; all other words fall into ``SHAPES`` classes by their last bytes.  Inside a
class, words have smoothed relative frequencies, with one place for unseen words:

    p(text) = sum over state paths of prod p(state | state before) * p(class | state)
              * prod p(word | class),   p(word | class) = (c + 0.5) / (C + 0.5 * (D + 1))

with c, C, D the word's count, the class's tokens and its different words in training.
The first factor is computed exactly by the scaled forward recursion.

Training: expected counts of starts, turns and emissions (forward and backward over every
training text) are summed over partitions by class.  Rounds start from the corpus's class
counts times seeded noise, other in each state, with states that seldom change, so that the
first round parts whole texts.  Until they settle (one gains at most ``SETTLED`` nats a
token), rounds take every ``SHARE``-th training text by hash; then they take the whole
training corpus, again until one gains no more than that.

The base score is the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))).

Scale: rare words are too many to broadcast.  Texts become sequences of class numbers, two
bytes a token, in a shared table; rare words lie beside them, travel once as (hash,
document, times), join the word counts by hash, and come back as one sum a document and
task.  All words are counted, summed by task before the shuffle, and the frequent ones are
the first by count, ties by the word, however the texts are partitioned.  The model has
``STATES * (HEAD + SHAPES)`` numbers, whatever the corpus.

Defined cases: null or empty texts hold the end token only; repeated rows each get the same
score and each count in training; rows that share a doc_id but differ in text each get their
own; null doc_ids hash as the empty string; a very long text takes its steps in stretches of
``PLACES`` tokens, whole; other columns are not looked at; without training texts all counts
are zero and the states uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, crc_bucket, map_arrow, read, utf8

HEAD, SHAPES, STATES = 4096, 1024, 8
SETTLED, SEED = 3e-4, 5
#: Training texts to one that the first rounds take.
SHARE = 8
#: Texts that take a step of the recursion together, the most places (texts times longest text) of such a group, and texts that are dealt into groups at once.
SLOTS, PLACES, TOGETHER = 4096, 1 << 19, 8192
END = 0
LOG10 = float(np.log(10.0))


def shape(word: bytes) -> int:
    """The class of a rare word, by its last three bytes and whether it is long."""
    return zlib.crc32(word[-3:] + (b"+" if len(word) > 8 else b"")) % SHAPES


class Vocabulary:
    """Class numbers: 0 the end, 1.. the frequent words, then the shapes. Rare words are remembered up to a bound."""

    def __init__(self, head: list[bytes]) -> None:
        self.first = len(head) + 1
        self.classes = self.first + SHAPES
        self.head = {w: i + 1 for i, w in enumerate(head)}
        self.known = dict(self.head)

    def numbers(self, words: list[bytes], different: Iterable[bytes]) -> list[int]:
        """The classes of the words and the end; different: each word once."""
        known = self.known
        if len(known) > 400_000:
            known = self.known = dict(self.head)
        for w in different:
            if w not in known:
                known[w] = self.first + shape(w)
        return [*map(known.__getitem__, words), END]


@dataclass
class Model:
    start: np.ndarray  # (S,)
    turn: np.ndarray  # (S, S)
    emit: np.ndarray  # (classes, S)


def batches_of(texts: list[np.ndarray]) -> list[list[int]]:
    """Indices of texts, longest first, in groups whose padding is small."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    groups: list[list[int]] = []
    for i in order:
        most = len(texts[groups[-1][0]]) if groups else 0
        if groups and len(groups[-1]) < SLOTS and 2 * len(texts[i]) >= most and most * (len(groups[-1]) + 1) <= PLACES:
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


def padded(texts: list[np.ndarray], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(time, text) class numbers of a group, longest first, and how many texts are alive at each time."""
    sizes = np.array([len(texts[i]) for i in group])
    obs = np.zeros((sizes[0], len(group)), np.uint16)
    for j, i in enumerate(group):
        obs[: sizes[j], j] = texts[i]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    return obs, alive


def forward(model: Model, seen: np.ndarray, alive: np.ndarray, keep: bool = False, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Natural log-likelihood of each text by the scaled forward recursion; the scaled alphas (with keep), the scales and the last alphas.

    seen: (time, text, state), the emission probability of each token; before: the last alphas of the time before, if texts began earlier.
    """
    time, count, states = seen.shape
    scales = np.ones((time, count), seen.dtype)
    alphas = np.zeros(seen.shape, seen.dtype) if keep else None
    turn, ones = model.turn.astype(seen.dtype), np.ones(states, seen.dtype)
    a = model.start.astype(seen.dtype) * seen[0] if before is None else before
    for t in range(time):
        n = alive[t]
        if t or before is not None:
            a = a[:n] @ turn
            a *= seen[t, :n]
        s = a @ ones
        a /= s[:, None]
        scales[t, :n] = s
        if keep:
            alphas[t, :n] = a
    return np.log(scales).sum(0, dtype=np.float64), alphas, scales, a


def likelihoods(model: Model, obs: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Natural log-likelihood of each text, and the alphas before each stretch of ``PLACES`` times."""
    total, before = np.zeros(obs.shape[1]), [None]
    for at in range(0, len(obs), PLACES):
        part = slice(at, at + PLACES)
        logs, _, _, last = forward(model, np.take(model.emit, obs[part], axis=0), alive[part], before=before[-1])
        total += logs
        before.append(last)
    return total, before


def expected(model: Model, texts: list[np.ndarray], counts: Model) -> float:
    """Adds the expected counts of the texts to counts; returns their log-likelihood.

    A long text goes in stretches: the forward pass keeps the alphas between them, and the
    backward pass takes them from the last to the first, so memory is bounded whatever its length.
    """
    gained = 0.0
    classes, states = model.emit.shape
    emit, turn = model.emit.astype(np.float32), model.turn.astype(np.float32)
    narrow, back = Model(model.start, model.turn, emit), np.ascontiguousarray(turn.T)
    for group in batches_of(texts):
        obs, alive = padded(texts, group)
        time, count = obs.shape
        before = likelihoods(narrow, obs, alive)[1] if time > PLACES else [None]
        beta = np.ones((count, states), np.float32)
        after = None  # (beta * seen) of the time after a stretch
        for at in range((time - 1) // PLACES * PLACES, -1, -PLACES):
            part, live = obs[at : at + PLACES], alive[at : at + PLACES]
            seen, steps = np.take(emit, part, axis=0), len(part)
            total, alphas, scales, _ = forward(narrow, seen, live, keep=True, before=before[at // PLACES])
            gained += total.sum()
            betas, onward = np.zeros(seen.shape, np.float32), np.zeros(seen.shape, np.float32)
            seen /= scales[:, :, None]
            if after is not None:
                counts.turn += (alphas[-1, : len(after)].T @ after) * model.turn
                np.matmul(after, back, out=beta[: len(after)])
            betas[-1, : live[-1]] = beta[: live[-1]]
            for t in range(steps - 2, -1, -1):
                n, m = live[t], live[t + 1]
                np.multiply(seen[t + 1, :m], beta[:m], out=onward[t + 1, :m])
                np.matmul(onward[t + 1, :m], back, out=beta[:m])
                betas[t, :n] = beta[:n]
            after = seen[0, : live[0]] * beta[: live[0]]
            counts.turn += (alphas[:-1].reshape(-1, states).T @ onward[1:].reshape(-1, states)) * model.turn
            betas *= alphas
            if not at:
                counts.start += betas[0].sum(0)
            there = np.arange(count)[None, :] < live[:, None]
            where, what = part[there], betas[there]
            for s in range(states):
                counts.emit[:, s] += np.bincount(where, what[:, s], classes)
    return float(gained)


def normalised(counts: Model) -> Model:
    """Relative expected counts, with small added counts so that nothing is impossible."""
    start, turn, emit = counts.start + 0.5, counts.turn + 0.5, counts.emit + 0.02
    return Model(start / start.sum(), turn / turn.sum(1, keepdims=True), emit / emit.sum(0))


def empty(classes: int) -> Model:
    return Model(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((classes, STATES)))


def first_model(sizes: np.ndarray) -> Model:
    """A seeded model without symmetry, from the training tokens of each class."""
    counts = empty(len(sizes))
    counts.emit += sizes[:, None] * np.random.default_rng(SEED).gamma(4, 1 / 4, (len(sizes), STATES))
    model = normalised(counts)
    model.turn = np.eye(STATES) * 0.999 + 0.001 / STATES
    return model


def word_counts(train: DataFrame) -> DataFrame:
    """(word, hash, shape, c): each word of the training texts with its exact count."""

    def count(batches):
        from collections import Counter

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.lower().split())
                if len(seen) > 300_000:
                    yield rows()
                    seen.clear()
        yield rows()

    counts = map_arrow(train.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    ending = F.concat(F.substring("word", -3, 3), F.when(F.length("word") > 8, F.lit(b"+")).otherwise(F.lit(b"")))
    return counts.select("word", F.xxhash64("word").alias("hash"), (F.crc32(ending) % SHAPES).cast("short").alias("shape"), "c")


def frequent_words(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, ties by the word; at most ``most``."""
    return [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(most).select("word", "c").collect()]


def encoded(docs: DataFrame, head: list[bytes]) -> DataFrame:
    """(doc_id, key, held_out, tokens, classes, hashes, times, row): classes holds two bytes a token; hashes and times the rare words; row numbers the rows once they are saved."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def encode(batches):
        from collections import Counter

        import xxhash

        names = Vocabulary(sent.value)
        for batch in batches:
            made, hashes, times = [], [], []
            for text in batch.column(3).to_pylist():
                words = text.lower().split()
                each = Counter(words)
                made.append(np.array(names.numbers(words, each), np.uint16).tobytes())
                rare = [w for w in each if w not in names.head]
                hashes.append(np.array([xxhash.xxh64_intdigest(w, 42) for w in rare], np.uint64).view(np.int64))
                times.append(np.array([each[w] for w in rare], np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(m) // 2 for m in made], pa.int64()), pa.array(made, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "key", "held_out", "tokens", "classes", "hashes", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "key", "held_out", "text"), encode, f"doc_id {kind}, key long, held_out boolean, tokens long, classes binary, hashes array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id())


def baum_welch_round(coded: DataFrame, model: Model) -> tuple[Model, float]:
    """One round over all training texts: expected counts summed by class over partitions; the new model and the old one's log-likelihood."""
    classes = len(model.emit)
    sent = coded.sparkSession.sparkContext.broadcast((model.start, model.turn, model.emit))

    def expect(batches):
        now, counts, gained = Model(*sent.value), empty(classes), 0.0
        for batch in batches:
            gained += expected(now, [np.frombuffer(c, np.uint16) for c in batch.column(0).to_pylist()], counts)
        rows = np.concatenate([counts.emit, counts.turn, counts.start[None, :], np.full((1, STATES), gained)])
        hit = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), *[pa.array(rows[hit, s]) for s in range(STATES)]], names=["row", *[f"s{s}" for s in range(STATES)]])

    sums = map_arrow(coded.where("not held_out").select("classes"), expect, "row long, " + ", ".join(f"s{s} double" for s in range(STATES)), TOGETHER)
    total = np.zeros((classes + STATES + 2, STATES))
    for r in sums.groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)]).collect():
        total[r.row] = r[1:]
    return normalised(Model(total[-2], total[classes:-2], total[:classes])), total[-1, 0]


def baum_welch(coded: DataFrame, model: Model, tokens: int, rounds: int | None = None) -> Model:
    """Rounds over all training texts until the likelihood settles, or as many as given.

    Unless their number is given, rounds over every ``SHARE``-th training text, until those settle, bring the
    model near; they cost little and grow with the corpus too. What ends the training is the whole corpus.
    """
    if rounds is None:
        some = coded.where(F.pmod("key", F.lit(SHARE)) == 0)
        # as many texts to a task as in a whole round: texts share the steps of the recursions
        some = some.coalesce(max(1, some.rdd.getNumPartitions() // SHARE))
        held = some.where("not held_out").agg(F.sum("tokens").alias("n")).first().n
        if held:
            model = settled(some, model, held)
    return settled(coded, model, tokens, rounds)


def settled(coded: DataFrame, model: Model, tokens: int, rounds: int | None = None) -> Model:
    last, k = -np.inf, 0
    while rounds is None or k < rounds:
        model, now = baum_welch_round(coded, model)
        if now - last <= SETTLED * tokens:
            break
        last, k = now, k + 1
    return model


def score_texts(docs: DataFrame, shared: Shared, rounds: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (crc_bucket(F.col("doc_id"), 5) == 1).alias("held_out"), utf8("text").alias("text"))
    counted = shared.save(word_counts(docs.where("not held_out")), "counts")
    shared.release()
    head = frequent_words(counted)
    words = [w for w, _ in head]
    coded = shared.save(encoded(docs, words), "coded")
    classes = len(words) + 1 + SHAPES

    # rare words: their counts are summed back to documents
    rare = coded.select("row", F.inline(F.arrays_zip("hashes", "times"))).withColumnRenamed("hashes", "hash")
    last = head[-1] if head else (b"", 0)
    counts = counted.where((F.col("c") < last[1]) | (F.col("c") == last[1]) & (F.col("word") > F.lit(bytearray(last[0]))))
    by_shape = {r["shape"]: (r.c, r.d) for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("d")).collect()}
    ends = coded.agg(F.count_if(~F.col("held_out")).alias("n")).first().n
    c_head = np.array([ends, *[n for _, n in head]], np.float64)
    n_train = int(c_head.sum()) + sum(c for c, _ in by_shape.values())
    v_train = len(words) + (ends > 0) + sum(d for _, d in by_shape.values())
    sizes = np.concatenate([c_head, [by_shape.get(k, (0, 0))[0] for k in range(SHAPES)]])
    model = baum_welch(coded, first_model(sizes), n_train, rounds)
    floor = np.log10(n_train + 0.5 * (v_train + 1))
    # what a token of each class adds to either score beside its rare word's log10(c + 0.5)
    inside = np.zeros(classes)
    for k in range(SHAPES):
        c, d = by_shape.get(k, (0, 0))
        inside[len(words) + 1 + k] = -np.log10(c + 0.5 * (d + 1))
    base = np.zeros(classes)
    base[: len(c_head)] = np.log10(c_head + 0.5)
    known = np.zeros(classes, np.int64)
    known[: len(c_head)] = c_head > 0
    sent = docs.sparkSession.sparkContext.broadcast((model.start, model.turn, model.emit, base - floor, inside, known))

    def rate(batches):
        start, turn, emit, each_base, each_inside, sure = sent.value
        now = Model(start, turn, emit)
        for batch in batches:
            texts = [np.frombuffer(c, np.uint16) for c in batch.column(4).to_pylist()]
            got = np.zeros((len(texts), 3))
            for group in batches_of(texts):
                obs, alive = padded(texts, group)
                got[group, 0] = likelihoods(now, obs, alive)[0] / LOG10
            for i, t in enumerate(texts):
                got[i, 0] += each_inside[t].sum()
                got[i, 1], got[i, 2] = each_base[t].sum(), sure[t].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got[:, 2].astype(np.int64)), pa.array(got[:, 1]), pa.array(got[:, 0])], names=["doc_id", "row", "held_out", "n_tokens", "n_head", "base_part", "score_part"])

    kind = dict(coded.dtypes)["doc_id"]
    parts = map_arrow(coded.select("doc_id", "row", "held_out", "tokens", "classes"), rate, f"doc_id {kind}, row long, held_out boolean, n_tokens long, n_head long, base_part double, score_part double", TOGETHER)
    joined = rare.join(counts.groupBy("hash").agg(F.sum("c").alias("c")), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_part"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_rare"))
    sums = shared.save(sums, "sums")
    shared.drop("counts")
    shared.release()
    out = parts.join(sums, "row", "left")
    extra = F.coalesce("rare_part", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base_part") + extra).alias("base_score"), (F.col("score_part") + extra).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), Shared(spark))
