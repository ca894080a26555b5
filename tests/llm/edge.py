"""A small table with everything that may trouble an operator: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from siftwell.llm import curriculum_mixing, line_dedup, quality_rules

WORDS = ("the of and to in is it for on was with as that by from at are this be have not you we they one all can had her were there been their has would what will more when who him time some could them other than then now only its over also after".split())


def prose(seed, words, per_line=12):
    rng = random.Random(seed)
    out = []
    for i in range(words):
        w = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sé", "ba"]) for _ in range(rng.randint(1, 4)))
        out.append(w + (".\n" if i % per_line == per_line - 1 else " "))
    return "".join(out).strip()


BASE = prose(1, 160)


def edited(text, seed, share):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def texts():
    """(doc_id, text, source)"""
    rows = [(i, prose(100 + i, 60 + 7 * i), f"s{i % 3}") for i in range(12)]
    rows += [(20, BASE, "s0"), (21, BASE, "s0"), (22, edited(BASE, 2, 0.02), "s1"), (23, edited(BASE, 3, 0.02), None), (24, prose(5, 40) + "\n" + BASE, "s0"), (25, BASE + "\n" + BASE, "s2")]
    rows += [(30, None, "s0"), (31, "", None), (32, "   \n\t\n", "s1"), (33, "one two", "s1"), (34, "One TWO", "s2"), (35, "x" * 5000, "s0"), (36, "ab " * 400, "s0")]
    rows += [(40, prose(7, 3000), "s0"), (41, "LOUD!! WORDS!! " * 30, "s1"), (42, "a$$$ b*** c%%% " * 30, "s1"), (43, "é ü ß 漢字 🙂 " * 20, None)]
    rows += [(50, "tie", "s0"), (50, "tie", "s0"), (None, BASE, "s0"), (None, "null id", None)]
    return rows


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, kept int, score string, n_words string, rank int, node long, key string, label string"


def table(spark, rows=None):
    """The rows with more columns, named like those that operators make."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, s, None, len(t or ""), 7, "x", "y", 1, 2, "k", "l") for d, t, s in rows], SCHEMA)


OPERATORS_KEEPING_ROWS = {"quality": lambda docs, shared: quality_rules.judge(docs, quality_rules.Field()), "lines": line_dedup.dedup_lines, "mixing": lambda docs, shared: curriculum_mixing.mix(docs)}
