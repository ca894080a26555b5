"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Every non-blank line has a vector of signs (shouting, symbols, repeated words, repeated
lines, fragments, ...).  Viterbi decoding finds the likeliest label sequence of a document;
the share of its words in content lines decides retention, together with two hard rules.

Training: labels of lines are hidden.  A document's quality label is weak evidence on each
of its lines (``LABEL_SAYS``), a notice (link, licence, cookie, ...) stronger evidence for
boilerplate; the likelihood of that evidence, labels summed out by the forward and backward
recursions, is maximised by gradient ascent.  So clean lines of bad documents may be content,
and notices in good ones boilerplate.  It uses at most ``TRAIN_DOCS`` labelled
documents, those of least hash, of at most ``TRAIN_LINES`` lines each; everything else
covers whole texts of all documents.  Without labels of both kinds it uses
``DEFAULT_SIGNS``, weights set by hand.

Scale: one pass, no shuffle; the model is a few dozen numbers.

Defined cases: null or empty texts have no words, fail the base rules and are rejected;
a document without content or boilerplate words has content share 0; a very long text is
judged whole, all its lines in one sequence; repeated rows each get the same verdict; an empty table gives an empty result; columns named like ours are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read, utf8
from .text_stats import NOT_DIGIT, NOT_LETTER, NOT_UPPER, SYMBOLS, WHITE, base_counts, kept

TRAIN_DOCS, TRAIN_LINES = 2000, 400
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
SIGNS = ("bias", "shouting", "symbols", "many_symbols", "exclaims", "few_words_differ", "stutters", "seen_before", "fragment", "no_sentence_end", "digits", "long_words", "link_or_notice", "first", "last")
DEFAULT_SIGNS = (-2.0, 4.0, 2.5, 2.0, 3.0, 4.0, 3.0, 3.0, 0.5, 0.2, 0.5, 0.5, 0.5, 0.0, 0.0)
NOTICES = (b"http", b"www.", b"cookie", b"copyright", b"all rights reserved", b"subscribe", b"license")
#: Log-odds that a document's label gives each of its lines, and that a notice is boilerplate.
LABEL_SAYS, NOTICE_SAYS = 1.0, 3.0


@dataclass(frozen=True)
class Field:
    """signs: weight of each sign for the label boilerplate against content; turns[i][j]: from label i to j; start: boilerplate first."""

    signs: tuple[float, ...] = DEFAULT_SIGNS
    turns: tuple[tuple[float, float], tuple[float, float]] = ((0.5, -0.5), (-0.5, 0.5))
    start: float = 0.0


def line_signs(data: bytes) -> tuple[np.ndarray, list[int]]:
    """The signs of each line with a word, and its words."""
    rows, sizes, seen = [], [], set()
    for line in data.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size, letters = len(line), kept(line, NOT_LETTER)
        symbols = size - kept(line, SYMBOLS)
        stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) if n > 1 else 0
        low = line.lower()
        rows.append((
            1, n > 1 and kept(line, NOT_UPPER) > 0.3 * max(1, letters), symbols > 0.2 * n, symbols > n, line.count(b"!") > 0.4 * n, n > 5 and len(set(words)) < 0.5 * n, stutter > 0.2 * n, line in seen,
            n < 4, line.rstrip(WHITE)[-1:] not in b".!?:;\"'", kept(line, NOT_DIGIT) > 0.2 * size, size > 14 * n, any(x in low for x in NOTICES), not rows, 0,
        ))
        sizes.append(n)
        seen.add(line)
    made = np.array(rows, np.float64).reshape(len(rows), len(SIGNS))
    if rows:
        made[-1, -1] = 1
    return made, sizes


def viterbi(scores: list[float], field: Field) -> list[int]:
    """The likeliest labels (1: boilerplate) of lines with these scores for boilerplate; ties go to content."""
    if not scores:
        return []
    (cc, cb), (bc, bb) = field.turns
    content, boiler, back = 0.0, scores[0] + field.start, []
    for x in scores[1:]:
        to_c, to_b = boiler + bc > content + cc, boiler + bb > content + cb
        content, boiler = (boiler + bc if to_c else content + cc), (boiler + bb if to_b else content + cb) + x
        back.append((to_c, to_b))
    label = int(boiler > content)
    labels = [label]
    for step in reversed(back):
        label = int(step[label])
        labels.append(label)
    return labels[::-1]


@dataclass(frozen=True)
class Lines:
    """The lines of documents, longest document first: all first lines, then all second lines, ...

    signs: (line, sign); evidence: log-odds for boilerplate that the labels give; alive: documents that have a line at each time.
    """

    signs: np.ndarray
    evidence: np.ndarray
    alive: np.ndarray

    @classmethod
    def of(cls, sequences: list[tuple[np.ndarray, np.ndarray]]) -> Lines:
        """From (signs, evidence) of each document."""
        sequences = sorted(sequences, key=lambda d: -len(d[0]))
        sizes = np.array([len(x) for x, _ in sequences])
        order = np.argsort(np.concatenate([np.arange(n) for n in sizes]), kind="stable")
        return cls(np.concatenate([x for x, _ in sequences])[order], np.concatenate([e for _, e in sequences])[order], np.searchsorted(-sizes, -np.arange(sizes[0]), side="left"))


def marginals(node: np.ndarray, turns: np.ndarray, alive: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the documents' log partition functions, the probability of boilerplate of each line, and the expected turns, by forward and backward recursion."""
    begin = np.concatenate([[0], np.cumsum(alive)])
    a, b, log_z = node.copy(), np.zeros_like(node), np.zeros(len(node))
    for t in range(1, len(alive)):
        before, now = slice(begin[t - 1], begin[t - 1] + alive[t]), slice(begin[t], begin[t + 1])
        a[now] += np.logaddexp(a[before, :1] + turns[0], a[before, 1:] + turns[1])
    for t in range(len(alive) - 2, -1, -1):
        here, after = slice(begin[t], begin[t] + alive[t + 1]), slice(begin[t + 1], begin[t + 2])
        came = node[after] + b[after]
        b[here] = np.logaddexp(turns[:, 0] + came[:, :1], turns[:, 1] + came[:, 1:])
    first = np.logaddexp(a[: alive[0], 0] + b[: alive[0], 0], a[: alive[0], 1] + b[: alive[0], 1])
    for t in range(len(alive)):
        log_z[begin[t] : begin[t + 1]] = first[: alive[t]]
    pairs = np.zeros((2, 2))
    before = np.concatenate([np.arange(begin[t - 1], begin[t - 1] + alive[t]) for t in range(1, len(alive))]) if len(alive) > 1 else np.zeros(0, np.int64)
    after = np.arange(begin[1], len(node))
    for i in range(2):
        for j in range(2):
            pairs[i, j] = np.exp(a[before, i] + turns[i, j] + node[after, j] + b[after, j] - log_z[after]).sum()
    return float(first.sum()), np.exp(a[:, 1] + b[:, 1] - log_z), pairs


def likelihood(lines: Lines, theta: np.ndarray, decay: float, turn_decay: float) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the evidence, labels summed out, and its gradient: expectations given the evidence less those without."""
    k, docs = len(SIGNS), int(lines.alive[0])
    w, turns, start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4]
    node = np.stack([np.zeros(len(lines.signs)), lines.signs @ w], -1)
    node[:docs, 1] += start
    given = node.copy()
    given[:, 1] += lines.evidence
    held, q, held_pairs = marginals(given, turns, lines.alive)
    free, p, free_pairs = marginals(node, turns, lines.alive)
    grad = np.concatenate([lines.signs.T @ (q - p), (held_pairs - free_pairs).ravel(), [(q - p)[:docs].sum()]]) / docs
    cost = np.full(len(theta), decay)
    cost[k : k + 4] = turn_decay
    return (held - free) / docs - float((cost * theta**2).sum()), grad - 2 * cost * theta


def evidence(signs: np.ndarray, bad: int) -> np.ndarray:
    """Log-odds for boilerplate of the lines of a document: what its label says, except that notices are boilerplate wherever they stand."""
    return np.where(signs[:, SIGNS.index("link_or_notice")] > 0, NOTICE_SAYS, LABEL_SAYS if bad else -LABEL_SAYS)


def fit(sequences: list[tuple[np.ndarray, int]], rounds: int = 120, decay: float = 1e-3, turn_decay: float = 3e-2) -> Field:
    """Field for (signs of the lines, label: 1 is bad) of documents, by Adam steps on the whole sample. One label only: the default field."""
    sequences = [(x, y) for x, y in sequences if len(x)]
    if len({y for _, y in sequences}) < 2:
        return Field()
    lines = Lines.of([(x, evidence(x, y)) for x, y in sequences])
    f = Field()
    theta = np.array([*f.signs, *f.turns[0], *f.turns[1], f.start])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, grad = likelihood(lines, theta, decay, turn_decay)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    k = len(SIGNS)
    return Field(tuple(theta[:k]), ((theta[k], theta[k + 1]), (theta[k + 2], theta[k + 3])), float(theta[k + 4]))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """Field learnt from at most ``most`` labelled documents."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def signs(batches):
        for batch in batches:
            made = [line_signs(t)[0] for t in batch.column(0).to_pylist()]
            good = [i for i, x in enumerate(made) if 0 < len(x) <= TRAIN_LINES]
            yield pa.RecordBatch.from_arrays([pa.array([made[i].astype(np.int8).tobytes() for i in good], pa.binary()), batch.column(1).take(pa.array(good, pa.int64())), batch.column(2).take(pa.array(good, pa.int64()))], names=["signs", "quality", "doc_id"])

    # one text an id, so that as many rows come to the driver as ids were chosen
    some = docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("quality").alias("quality"))
    some = some.select("text", F.col("quality").cast("int").alias("quality"), F.col("doc_id").cast("string").alias("doc_id"))
    rows = map_arrow(some, signs, "signs binary, quality int, doc_id string").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.signs)))  # the same sums in any order of tasks
    return fit([(np.frombuffer(bytes(r.signs), np.int8).reshape(-1, len(SIGNS)).astype(np.float64), 1 - r.quality) for r in rows])


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, content_share, line_labels, kept.

    line_labels: one character for each line with a word, c or b.
    """
    own = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, line_labels string"
    names = [x.split()[0] for x in own.split(", ")]
    docs = docs.drop(*names, "base_failed", "content_share", "kept")

    def count(batches):
        w = np.array(field.signs)
        for batch in batches:
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                n, chars, symbols, dup, again, _, _ = base_counts(data)
                signs, sizes = line_signs(data)
                labels = viterbi((signs @ w).tolist(), field)
                rows.append((n, chars, symbols, dup, again, sum(s for s, b in zip(sizes, labels, strict=True) if not b), "".join("cb"[b] for b in labels)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*batch.schema.names[:-1], *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], own])
    out = map_arrow(docs.withColumn("_bytes", utf8("text")), count, schema)
    n, share = F.col("n_words"), F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0)
    out = out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).withColumn("content_share", share)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= MIN_CONTENT))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
