"""Burrows-Wheeler transforms of collections of short byte strings, and their merge.

Each string is taken as a cycle closed by a terminator that sorts before all
bytes, so rows are rotations and the terminators' rows follow from the strings.
A symbol is ``step`` bytes; the symbols of a collection are numbered in their
order, and a transform holds for each row the symbol in front of its rotation.

``transform`` sorts one shard's rotations by prefix doubling.  ``merge`` never
sorts rotations again: it starts from "all rows of shard 0, then of shard 1, ..."
and refines that interleave, in each round stably dealing the shards' rows out by
the symbol in front of them.  After r rounds the interleave is that of the rows'
first r symbols, and a boundary that appears in round r lies between rows that
have r - 1 symbols in common: the common prefixes come for free, to the byte
from the two symbols that part the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Most bytes of a symbol.
STEP = 25
_POSITION = np.uint64((1 << 32) - 1)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number among the distinct keys in order, an order) of each key below 2**63."""
    n = len(key)
    bits = max(1, n - 1).bit_length()
    if n and int(key.max()).bit_length() + bits <= 64:  # a plain sort of keys with their places is the quicker one
        both = np.sort(key.astype(np.uint64) << np.uint64(bits) | np.arange(n, dtype=np.uint64))
        key, order = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int32)
    else:
        order = np.argsort(key)
        key = key[order]
    new = np.zeros(n, np.int32)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(n, np.int32)
    number[order] = np.cumsum(new, dtype=np.int32)
    return number, order


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) * (int(b.max()) + 1) + b if len(a) else np.zeros(0, np.int64)


class Collection:
    """Strings behind one another, each with a terminator, and the symbol that begins at each place."""

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        self.step = next(k for k in range(min(STEP, depth), 0, -1) if depth % k == 0)
        sizes = np.array([len(s) + 1 for s in strings], np.int32)
        self.ends = np.cumsum(sizes)
        n = int(self.ends[-1]) if len(sizes) else 0
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        self.first = np.repeat((self.ends - sizes).astype(np.int32), sizes)
        self.size = np.repeat(sizes, sizes)
        self.at = np.arange(n, dtype=np.int32) - self.first
        self.code = np.zeros(n, np.uint8)  # bytes in use, numbered in their order from 1; none is 255
        inner = np.ones(n, bool)
        inner[self.ends - 1] = False
        raw = np.frombuffer(b"".join(strings), np.uint8)
        used = np.zeros(256, bool)
        used[raw] = True
        self.code[inner] = np.cumsum(used)[raw]
        width = min(7, self.step)
        word = np.zeros(n, np.int64)
        for k in range(width):
            word = word << 8 | self.code[self.ahead(k)]
        symbol, _ = _numbered(word)
        while width < self.step:
            more = min(width, self.step - width)
            symbol, _ = _numbered(_pairs(symbol, symbol[self.ahead(more)]))  # two words that may overlap
            width += more
        self.symbol = symbol

    def ahead(self, by: int) -> np.ndarray:
        """The place ``by`` places further on in each place's cycle."""
        to = self.at + np.int32(by)
        if len(to) and by < int(self.size.min()):  # once around at most
            return self.first + np.where(to >= self.size, to - self.size, to)
        return self.first + to % self.size


@dataclass(frozen=True)
class Shard:
    """Rows in order: the symbol in front of each rotation, and the place where the rotation begins."""

    front: np.ndarray
    place: np.ndarray


def transform(all_: Collection, a: int, b: int) -> Shard:
    """The transform of strings a to b - 1, with rotations ordered by at least their first ``depth`` bytes."""
    lo, hi = int(all_.ends[a - 1]) if a else 0, int(all_.ends[b - 1])
    own = slice(lo, hi)
    first, size, at = all_.first[own] - lo, all_.size[own], all_.at[own]
    number, order = _numbered(all_.symbol[own])
    width = all_.step
    follow = first + (at + width) % size
    while width < all_.depth:
        number, order = _numbered(_pairs(number, number[follow]))
        follow, width = follow[follow], 2 * width
    front = all_.symbol[own][first + (at - all_.step) % size]
    return Shard(front[order], order + np.int32(lo))


def merge(shards: list[Shard], rounds: int) -> tuple[Shard, np.ndarray]:
    """The shards' common transform, and for each row how many symbols it shares with the row before, or -1 for ``rounds`` or more."""
    sizes = [len(s.front) for s in shards]
    n = sum(sizes)
    front = np.concatenate([s.front for s in shards]) if shards else np.zeros(0, np.int32)
    key = front.astype(np.uint64) << np.uint64(32)
    which = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    block = np.zeros(n, np.int32)
    shared = np.full(n, -1, np.int32)
    shared[:1] = 0
    at = np.arange(n, dtype=np.uint64)
    for r in range(rounds):
        symbol = np.empty(n, np.uint64)
        symbol[np.argsort(which, kind="stable")] = key
        both = np.sort(symbol | at)  # stable, as places break ties
        symbol, order = both >> np.uint64(32), (both & _POSITION).astype(np.int32)
        block, which = block[order], which[order]
        new = np.zeros(n, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        shared[new & (shared < 0)] = r
        block = np.cumsum(new, dtype=np.int32)
        if n and block[-1] == n - 1:
            break  # every row stands alone
    by_shard = np.argsort(which, kind="stable")
    merged = Shard(np.empty(n, np.int32), np.empty(n, np.int32))
    if n:
        merged.front[by_shard] = front
        merged.place[by_shard] = np.concatenate([s.place for s in shards])
    return merged, shared


def common_bytes(all_: Collection, rows: Shard, shared: np.ndarray) -> np.ndarray:
    """For each row the prefix that it shares with the row before, up to ``depth`` bytes."""
    out = np.full(len(shared), all_.depth, np.int64)
    out[:1] = 0
    parted = np.flatnonzero(shared >= 0)[1:]
    differ = np.ones((len(parted), all_.step), bool)
    for k in range(all_.step):
        skip = shared[parted] * all_.step + k
        one, two = (all_.code[all_.first[p] + (all_.at[p] + skip) % all_.size[p]] for p in (rows.place[parted - 1], rows.place[parted]))
        differ[:, k] = one != two
    out[parted] = np.minimum(shared[parted] * all_.step + differ.argmax(axis=1), all_.depth)
    return out


def shards_of(all_: Collection, shard_bytes: int) -> list[Shard]:
    cuts = [0]
    while cuts[-1] < len(all_.ends):
        before = int(all_.ends[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(all_.ends, before + shard_bytes, "right"))))
    return [transform(all_, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def repeated_starts(strings: list[bytes], span: int, copies: np.ndarray | None = None, shard_bytes: int = 1 << 17) -> list[np.ndarray]:
    """For each string the positions at which ``span`` bytes start that start elsewhere in the collection too.

    ``copies``: how many equal strings each one stands for.  Its rows stand for as many
    equal rows, which would lie next to each other in every transform.
    """
    out = [np.zeros(0, np.int64) for _ in strings]
    long = [k for k, s in enumerate(strings) if len(s) >= span]
    if not long:
        return out
    all_ = Collection([strings[k] for k in long], span)
    rows, shared = merge(shards_of(all_, shard_bytes), span // all_.step)
    weight = np.ones(len(long)) if copies is None else np.asarray(copies, np.float64)[long]
    interval = np.cumsum(shared >= 0) - 1  # rows with ``span`` bytes in common
    again = np.bincount(interval, weight[all_.string[rows.place]])[interval] > 1
    found = np.sort(rows.place[again])
    found = found[all_.at[found] + span < all_.size[found]]
    string, at = all_.string[found], all_.at[found].astype(np.int64)
    cut = np.flatnonzero(np.diff(string)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(string)).tolist(), strict=True):
        if b > a:
            out[long[int(string[a])]] = at[a:b]
    return out
