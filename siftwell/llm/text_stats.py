"""Counts of one text, from its UTF-8 bytes. Used by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

WHITE = bytes([0x20, *range(0x09, 0x0E)])
CONTINUED = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
NOT_UPPER = bytes(set(range(256)) - set(range(0x41, 0x5B)))
NOT_LETTER = bytes(set(range(256)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B)) - set(range(0x80, 0x100)))
NOT_DIGIT = bytes(set(range(256)) - set(range(0x30, 0x3A)))


def kept(data: bytes, without: bytes) -> int:
    """How many bytes of data are not in ``without``."""
    return len(data.translate(None, without))


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """The words as numbers in order of first use, and how many differ."""
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    return np.array(ids, np.int64), len(known)


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, first occurrence included."""
    count = len(ids) - width + 1
    if count < 2:
        return 0
    key, base = ids[:count].copy(), distinct
    for k in range(1, width):
        if base > (1 << 62) // max(1, distinct):  # keys would overflow: number them anew
            _, key = np.unique(key, return_inverse=True)
            base = int(key.max()) + 1
        key = key * distinct + ids[k : k + count]
        base *= distinct
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    inside = np.zeros(len(ids), bool)
    for k in range(width):
        inside[k : k + count] |= hit
    return int(inside.sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int, np.ndarray, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then word ids and distinct words."""
    words = data.split()
    ids, distinct = word_ids(words)
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(WHITE):
            seen.add(line)
    return len(words), kept(data, WHITE + CONTINUED), len(data) - kept(data, SYMBOLS), repeated, repeated_words(ids, distinct), ids, distinct
