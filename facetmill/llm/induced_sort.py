"""Suffix sorting by induction with queues on disk, which carry common prefixes.

``order`` sorts the suffixes of a byte string to a depth that is asked for, and tells
for each how much it has in common with the one before it, up to that depth. Suffixes
are of L or S type; those of S type after one of L type (S*) are sorted first: the
strings between two of them get names in their order, and the string of names is
sorted in turn. All others follow by induction: sorted suffixes, taken symbol by
symbol, put the suffix before each into the queue of its own first symbol, in order.
Queues are first-in-first-out for each symbol, which makes them a priority queue by
(symbol, rank of the rest); what they hold beyond a limit goes to files. An entry is a
place and the common prefix with the entry before it in its queue: one more than the
least common prefix among the suffixes taken since that entry was put in. Where the
suffixes of L and of S type of a symbol meet, it is the shorter run of that symbol;
S* neighbours are compared eight bytes at a time.

The text may be a memory map; besides the files, the types of places (a byte each) and
the S* suffixes with their names and common prefixes are held in memory.

Steps work on whole blocks of a queue with numpy: what one block sends to its own
symbol is the next block. The string of names is sorted by doubling, as the
alphabet of names is too large for a queue for each symbol.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
#: Bytes of entries that all queues together hold in memory.
LIMIT = 32 << 20


class Queues:
    """First-in-first-out queues of entries (numbers) by symbol; blocks go to files beyond ``limit`` bytes."""

    def __init__(self, symbols: int, limit: int = LIMIT):
        self.held: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: list[str | None] = [None] * symbols
        self.size, self.limit, self.folder = 0, limit, None

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Entries in the order of their symbols."""
        if not len(positions):
            return
        cuts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(symbols)).tolist(), strict=True):
            self.held[symbols[a]].append(positions[a:b].copy())
        self.size += positions.nbytes
        if self.size > self.limit:
            self.spill()

    def spill(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp()
        for s, blocks in enumerate(self.held):
            if blocks:
                self.files[s] = self.files[s] or os.path.join(self.folder, str(s))
                with open(self.files[s], "ab") as f:
                    for b in blocks:
                        b.tofile(f)
                self.held[s] = []
        self.size = 0

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """All positions of a symbol in order, in blocks; what comes in meanwhile comes too."""
        while self.files[symbol] or self.held[symbol]:
            if path := self.files[symbol]:
                self.files[symbol] = None
                os.rename(path, path + ".read")
                with open(path + ".read", "rb") as f:
                    while len(x := np.fromfile(f, np.int64, BLOCK)):
                        yield x
                os.remove(path + ".read")
                continue  # what was spilled meanwhile comes before what is held
            blocks, self.held[symbol] = self.held[symbol], []
            self.size -= sum(b.nbytes for b in blocks)
            if blocks:
                x = np.concatenate(blocks)
                for i in range(0, len(x), BLOCK):
                    yield x[i : i + BLOCK]

    def take_back(self, symbol: int) -> Iterator[np.ndarray]:
        """All entries of a symbol in blocks, the last block first; nothing may come in meanwhile."""
        blocks, self.held[symbol] = self.held[symbol], []
        self.size -= sum(b.nbytes for b in blocks)
        if blocks:
            x = np.concatenate(blocks)
            for end in range(len(x), 0, -BLOCK):
                yield x[max(0, end - BLOCK) : end]
        if path := self.files[symbol]:
            self.files[symbol] = None
            with open(path, "rb") as f:
                for end in range(os.path.getsize(path) // 8, 0, -BLOCK):
                    a = max(0, end - BLOCK)
                    f.seek(8 * a)
                    yield np.fromfile(f, np.int64, end - a)
            os.remove(path)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def is_small(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of S type, block by block from the end; the last is of L type."""
    n = len(text)
    out = np.zeros(n, bool)
    after, kind = None, False
    for b in range(n, 0, -BLOCK):
        a = max(0, b - BLOCK)
        x = text[a:b].astype(np.int16)
        d = np.empty(len(x), np.int16)
        d[:-1] = x[1:] - x[:-1]
        d[-1] = 0 if after is None else after - x[-1]
        if after is None:
            d[-1] = -1
        at = np.where(d != 0, np.arange(len(d)), len(d))
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        out[a:b] = np.where(nxt < len(d), d[np.minimum(nxt, len(d) - 1)] > 0, kind)
        after, kind = x[0], out[a]
    return out


#: What a chunk has past the r-th symbol.
_PAST = np.array([(1 << 64) - 1 >> 8 * r for r in range(9)], np.uint64)
_ONES = np.uint64(0x0101010101010101)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as a number, without a copy of the text."""
    return np.ndarray((max(0, len(text) - 7),), ">u8", text, strides=(1,))


def _chunks(text: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Symbols 8k..8k+7 of each string, one up, as a number; past a string comes 255, at the text's end 0."""
    n, at = len(text), start + 8 * k
    out = np.zeros(len(start), np.uint64)
    fast = at + 8 <= n
    out[fast] = _eights(text)[at[fast]].astype(np.uint64) + _ONES
    slow = np.flatnonzero(~fast)
    for j in range(8):
        i = at[slow] + j
        x = np.where(i < n, text[np.minimum(i, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out[slow] = out[slow] << np.uint64(8) | x
    return out | _PAST[np.clip(size - 8 * k, 0, 8)]


def _common(text: np.ndarray, depth: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The common prefix, ``depth`` at most, of the suffixes at x and at y."""
    n, eights = len(text), _eights(text)
    out = np.zeros(len(x), np.uint8)
    left = np.arange(len(x))
    for k in range(0, depth, 8):
        a, b = x[left] + k, y[left] + k
        fast = np.maximum(a, b) + 8 <= n
        same = np.zeros(len(left), np.int64)
        d = eights[a[fast]].astype(np.uint64) ^ eights[b[fast]].astype(np.uint64)
        same[fast] = np.count_nonzero(d[:, None] <= _PAST[1:], axis=1)
        for i in np.flatnonzero(~fast).tolist():
            m = max(0, min(8, n - max(int(a[i]), int(b[i]))))
            p, q = text[a[i] : a[i] + m], text[b[i] : b[i] + m]
            other = np.flatnonzero(p != q)
            same[i] = other[0] if len(other) else m
        out[left] = np.minimum(k + same, depth)
        left = left[same == 8]
        if not len(left):
            break
    return out


def _run(text: np.ndarray, at: int, depth: int) -> int:
    x = text[at : at + depth]
    other = np.flatnonzero(x != x[0])
    return int(other[0]) if len(other) else len(x)


class _Least:
    """The least common prefix among the suffixes taken since the last entry of each symbol."""

    def __init__(self, symbols: int, depth: int):
        self.since, self.depth = np.zeros(symbols, np.uint8), depth

    def entries(self, lcp: np.ndarray, at: np.ndarray, symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and entries, by symbol, of the places put in by suffixes ``at`` of a block with these common prefixes."""
        if not len(at):
            self.since = np.minimum(self.since, lcp.min(initial=255))
            return symbols, places
        order = np.argsort(symbols, kind="stable")
        s, i = symbols[order], at[order]
        lead = np.append(True, s[1:] != s[:-1])
        a = np.append(0, i[:-1] + 1)
        a[lead] = 0
        least = _range_min(lcp, a, i)
        least[lead] = np.minimum(least[lead], self.since[s[lead]])
        last = np.append(np.flatnonzero(lead)[1:], len(s)) - 1
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        self.since = np.minimum(self.since, tail[0])
        self.since[s[last]] = tail[i[last] + 1]
        return s, places[order] << 8 | (np.minimum(least, self.depth - 1).astype(np.int64) + 1)


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a..b] for each pair, by a table of the minima of powers of two."""
    level = np.frexp(b - a + 1)[1] - 1
    table = np.full((int(level.max()) + 1, len(x)), 255, np.uint8)
    table[0] = x
    for k in range(1, len(table)):
        h = 1 << k - 1
        np.minimum(table[k - 1, : len(x) - 2 * h + 1], table[k - 1, h : len(x) - h + 1], out=table[k, : len(x) - 2 * h + 1])
    return np.minimum(table[level, a], table[level, b - (1 << level.astype(np.int64)) + 1])


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sorted_stars(text: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """S* suffixes in order of their first ``depth`` symbols at least."""
    m = len(star)
    if m < 2:
        return star
    size = np.minimum(np.append(np.diff(star) + 1, len(text) - star[-1] + 1), depth + 8)
    name = _ranks([_chunks(text, star, size, 0)])
    k = 1
    while 8 * k < int(size.max()):
        # only strings that go on are told apart further
        more = size > 8 * k
        many = more & (np.bincount(name, minlength=m)[name] > 1)
        if not many.any():
            break
        rest = np.zeros(m, np.uint64)
        rest[:] = np.uint64(0xFFFFFFFFFFFFFFFF)
        rest[many] = _chunks(text, star[many], size[many], k)
        name = _ranks([name, rest])
        k += 1
    # doubling: names of 1, 2, 4, ... strings in a row, until they cover the depth
    step = 1
    while name.max() < m - 1:
        reach = np.append(star, np.full(step, star[-1] + depth))[step : step + m] - star
        if int(reach.min()) >= depth:
            break
        after = np.append(name[step:] + 1, np.zeros(min(step, m), np.int64))
        name = _ranks([name * np.int64(m + 1) + after])
        step *= 2
    return star[np.argsort(name, kind="stable")]


def order(text: np.ndarray, depth: int, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` (symbols below 254), largest first, in blocks, and their common prefixes with the one before.

    Suffixes are in order as far as their first ``depth`` symbols (255 at most) tell,
    and common prefixes are counted as far.
    """
    n = len(text)
    if not n:
        return
    small = is_small(text)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    star = _sorted_stars(text, star, depth)
    top = int(text.max()) + 1
    first = np.searchsorted(text[star], np.arange(top + 1)) if len(star) else np.zeros(top + 1, np.int64)
    up, large = Queues(top, limit), Queues(top, limit)

    def put(x: np.ndarray, lcp: np.ndarray, c: int, rising: bool) -> None:
        at = np.flatnonzero(x > 0)
        p = x[at] - 1
        s = text[p]
        ok = s >= c if rising else (s < c) | ((s == c) & small[p])
        up.push(*least.entries(lcp, at[ok], s[ok], p[ok]))

    try:
        least = _Least(top, depth)
        up.push(text[n - 1 :], np.array([n - 1 << 8], np.int64))
        for c in range(top):
            last = -1
            for e in up.take(c):
                x, lcp = e >> 8, (e & 255).astype(np.uint8)
                if last < 0:
                    lcp[0] = 0
                large.push(np.full(len(x), c), x << 8 | lcp)
                put(x, lcp, c, True)
                last = int(x[-1])
            for i in range(first[c], first[c + 1], BLOCK):
                x = star[i : min(i + BLOCK, first[c + 1])]
                lcp = np.append(np.uint8(0), _common(text, depth, x[:-1], x[1:]))
                if i > first[c]:
                    lcp[0] = _common(text, depth, star[i - 1 : i], x[:1])[0]
                elif last >= 0:
                    lcp[0] = min(_run(text, last, depth), _run(text, int(x[0]), depth))
                put(x, lcp, c, True)
        up.close()
        up, least = Queues(top, limit), _Least(top, depth)
        for c in range(top - 1, -1, -1):
            last = -1
            for e in up.take(c):
                x, lcp = e >> 8, (e & 255).astype(np.uint8)
                if last < 0:
                    lcp[0] = 0
                yield x, lcp
                put(x, lcp, c, False)
                last = int(x[-1])
            after = -1
            for e in large.take_back(c):
                x, own = e >> 8, (e & 255).astype(np.uint8)
                if after < 0:
                    after = min(_run(text, last, depth), _run(text, int(x[-1]), depth)) if last >= 0 else 0
                x, lcp = x[::-1], np.append(np.uint8(after), own[:0:-1])
                after = int(own[0])
                yield x, lcp
                # of one symbol, only suffixes of L type stand before these
                put(x, lcp, c, False)
    finally:
        up.close()
        large.close()
