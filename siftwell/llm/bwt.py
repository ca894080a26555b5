"""Burrows-Wheeler transforms of shards of texts, and their merge by interleave refinement.

A shard is a list of byte strings, each closed by an end mark that sorts before all bytes
and differs from all other end marks.  Its transform holds, in suffix order, the symbol
before each suffix.  To merge shards, only the interleave of their orders is sought: a
vector that says for each place which shard its suffix comes from.  Which suffix that is
follows from the shard's own order: the next one not placed yet.

The interleave is refined round by round.  Before round h suffixes lie in blocks that agree
in their first h symbols.  A round reads the transforms in the order of the interleave and
deals the places out by symbol, in one stable counting pass: what lay in a block goes, for
each symbol, to the block of the suffixes one symbol longer, in the same order.  Where
neighbours there come from different blocks they come apart, and h is their common prefix.
Only blocks whose own order changed in the last round, because they came apart, are read.
No two suffixes are compared and none is sorted anew: a shard whose order is wrong gives an
error or a wrong result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """symbols: the transform (0: an end mark); longer: where the suffix one longer stands; text, offset: places of the suffixes."""

    symbols: np.ndarray
    longer: np.ndarray
    text: np.ndarray
    offset: np.ndarray


def transform(texts: list[bytes], depth: int | None = None) -> Shard:
    """The shard of texts. Suffixes are sorted by prefix doubling, to the end or by their first ``depth`` symbols at least."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes) - 1
    starts, n = ends - sizes + 1, int(sizes.sum())
    # end marks are 0, 1, ... and bytes come after them
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + len(texts)
    data[ends] = np.arange(len(texts))
    ahead = np.zeros(n + 4, np.int64)
    ahead[:n] = data + 1
    wide = len(texts) + 258
    rank, h = ahead[:n].copy(), 1
    while h < 4 and wide ** (h + 1) < 1 << 62:
        rank = rank * wide + ahead[h : n + h]
        h += 1
    order = np.argsort(rank, kind="stable")
    fresh = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    while True:
        # a suffix's rank is the first place of those that are not told apart from it
        place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = place
        tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
        if not len(tied) or (depth is not None and h >= depth):
            break
        own = order[tied]
        key = rank[own] * (n + 1)
        inside = own + h < n
        key[inside] += rank[own[inside] + h] + 1
        sub = np.argsort(key, kind="stable")
        order[tied], key = own[sub], key[sub]
        fresh[tied[1:]] |= key[1:] != key[:-1]
        h *= 2
    text = np.repeat(np.arange(len(texts)), sizes)[order]
    offset = order - starts[text]
    before = np.where(offset > 0, data[np.maximum(order - 1, 0)] - len(texts) + 1, 0)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    return Shard(before.astype(np.int16), np.where(offset > 0, where[np.maximum(order - 1, 0)], -1), text, offset)


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave after ``depth`` rounds: for each place the suffix (its number in the shards laid end to end),
    its block (the first place of the suffixes with equal first ``depth`` symbols), and its common prefix with the one before (at most depth)."""
    sizes = np.array([len(s.symbols) for s in shards])
    base, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    before = np.concatenate([s.symbols for s in shards])
    longer = np.concatenate([np.where(s.longer >= 0, s.longer + b, -1) for s, b in zip(shards, base, strict=True)])
    small = before.max(initial=0) < 256
    # first symbols in a shard's order: its end marks, then as many of each symbol as its transform holds
    marks = [int((s.symbols == 0).sum()) for s in shards]
    heads = [np.concatenate([np.zeros(m, np.int16), np.repeat(np.arange(1, 258), np.bincount(s.symbols, minlength=258)[1:])]) for s, m in zip(shards, marks, strict=True)]
    shard = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    head = np.concatenate(heads).astype(np.int16)
    deal = np.argsort(head, kind="stable")
    shard, head = shard[deal], head[deal]
    # end marks all differ
    opens = np.concatenate([[True], (head[1:] != head[:-1]) | (head[1:] == 0)])
    prefix = np.where(opens, 0, depth).astype(np.int32)
    block = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    now, own = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(len(shards)):
        now[shard == s] = np.arange(base[s], base[s] + sizes[s])
    own[now] = block
    read = np.arange(n)
    for h in range(1, depth):
        symbol = before[now[read]]
        read, symbol = read[symbol > 0], symbol[symbol > 0]
        deal = np.argsort((symbol - 1).astype(np.uint8) if small else symbol, kind="stable")
        read = read[deal]
        if not len(read):
            break
        target = own[longer[now[read]]]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        group = np.cumsum(first) - 1
        at = target + np.arange(len(read)) - np.flatnonzero(first)[group]
        come = block[read]
        fresh = ~first & np.concatenate([[False], come[1:] != come[:-1]])
        if not fresh.any():
            break
        # blocks that come apart get their new interleave; suffixes follow in their shards' order
        split = (np.bincount(group[fresh], minlength=int(group[-1]) + 1) > 0)[group]
        at, fresh, dealt, opens = at[split], fresh[split], shard[read[split]], first[split] | fresh[split]
        there, were = now[at], shard[at]
        for s in range(len(shards)):
            now[at[dealt == s]] = there[were == s]
        shard[at] = dealt
        prefix[at[fresh]] = h
        block[at] = np.maximum.accumulate(np.where(opens, at, 0))
        own[now[at]] = block[at]
        read = at
    return now, block, prefix


def repeats(groups: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, group, text, offset) of the suffixes in blocks of two or more with equal first ``depth`` bytes: the
    repeated intervals of the merged transform. groups: the texts of each shard."""
    shards, numbers = [transform(g, depth + 1) for g in groups if g], [k for k, g in enumerate(groups) if g]
    if not shards:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    now, blocks, _ = merged(shards, depth)
    same = blocks[1:] == blocks[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    which = np.repeat(np.array(numbers), [len(s.symbols) for s in shards])
    text, offset = np.concatenate([s.text for s in shards]), np.concatenate([s.offset for s in shards])
    suffix = now[many]
    return blocks[many], which[suffix], text[suffix], offset[suffix]
