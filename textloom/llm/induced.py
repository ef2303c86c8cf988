"""Suffix sorting by induction with queues that may live on disk.

Suffixes are L (larger than the one that follows) or S. The S suffixes that follow an L suffix, S*, are sorted first: their substrings
by induction, then, where names repeat, the string of names by recursion. From sorted S* the L suffixes follow in ascending and the S
suffixes in descending order of first characters: a suffix that leaves its queue puts the one before it into the queue of its own
first character. These queues are a monotone priority queue: one for each character, first in first out, side by side in one array,
which is a mapped file once it is larger than ``memory``. Entries are (position, common prefix with the entry before). The common
prefix of two entries that follow each other in a queue is one more than the least common prefix between their sources.

Characters are taken in ranges as long as nothing that leaves a range goes into it, so whole arrays move at once.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = np.int32(1 << 30)
#: Entries that are tried at once, by the square root of the text's length: more of them more often meet in one range.
STEP = 1.0


class Store:
    """Arrays in memory up to ``memory`` bytes each, else in files of a private scratch folder that goes when the block is left."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.n = memory, None, 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            self.folder.cleanup()

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory or not n:
            return np.zeros(n, kind)
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="induced-")
        self.n += 1
        return np.memmap(os.path.join(self.folder.name, str(self.n)), kind, "w+", shape=(n,))


class _Minima:
    """Least values of ranges of one batch."""

    def __init__(self, x: np.ndarray):
        self.rows, width = [x], 1
        while 2 * width <= len(x):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of x[a..b] for each pair, a <= b."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            row = self.rows[level]
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << int(level)) + 1])
        return out


def _stable(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order; keys under 65536 sort by digits."""
    return np.argsort(keys.astype(np.uint16) if most <= 65536 else keys, kind="stable")


class _Queues:
    """Queues of characters 0..sigma-1 side by side; ``sign`` -1 counts places from the end, for descending order."""

    def __init__(self, store: Store, sizes: np.ndarray, with_lcp: bool):
        self.base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.fill = np.zeros(len(sizes), np.int64)
        self.pos = store.array(int(self.base[-1]), np.int32)
        self.lcp = store.array(int(self.base[-1]), np.int32) if with_lcp else None
        self.pending = np.zeros(len(sizes), np.int32) if with_lcp else None

    def put(self, chars: np.ndarray, pos: np.ndarray, source: np.ndarray, minima: _Minima | None, n: int) -> None:
        """Append (char, pos) in order of their sources 0..n-1 of a batch whose common prefixes ``minima`` has."""
        if len(chars):
            order = _stable(chars, len(self.fill))
            c, p = chars[order], pos[order]
            first = np.concatenate(([True], c[1:] != c[:-1]))
            heads = np.flatnonzero(first)
            sizes = np.diff(np.append(heads, len(c)))
            at = (self.base[c] + self.fill[c]) + (np.arange(len(c)) - np.repeat(heads, sizes))
            self.pos[at] = p
            if minima is not None:
                s = source[order]
                before = np.concatenate(([0], s[:-1] + 1))
                before[first] = 0
                lcp = minima.least(before, s)
                new = c[heads]
                lcp[heads] = np.where(self.fill[new] > 0, np.minimum(lcp[heads], self.pending[new]), -1)
                self.lcp[at] = lcp + 1
            self.fill[c[heads]] += sizes
        if minima is not None:
            whole = minima.least(np.array([0]), np.array([n - 1]))[0]
            np.minimum(self.pending, whole, out=self.pending)
            if len(chars):
                tails = s[np.append(heads[1:], len(c)) - 1]
                rest = tails + 1 < n
                value = np.full(len(tails), CAP, np.int32)
                value[rest] = minima.least(tails[rest] + 1, np.full(int(rest.sum()), n - 1))
                self.pending[c[heads]] = value


class _Pass:
    """One pass of induction: fills ``queues`` from themselves and from seeds, L suffixes ascending or S suffixes descending.

    Character c's seeds are ``seed_pos[start[c] : start[c] + size[c]]``, in the order of the pass; they come after the queue's own
    entries, ascending (S* after L) as well as descending (L after S).
    """

    def __init__(self, text, kind_l, queues: _Queues, start, size, seed_pos, seed_lcp, up: bool, run):
        self.text, self.kind_l, self.queues, self.up, self.run = text, kind_l, queues, up, run
        self.start, self.size, self.seed_pos, self.seed_lcp = start, size, seed_pos, seed_lcp
        self.done = np.zeros(len(size), np.int64)

    def meet(self, c: int) -> int:
        """Common prefix of the last entry of a queue and the first of the character's seeds: both begin with a run of it, then part."""
        q = self.queues
        if not q.fill[c]:
            return 0
        return min(int(self.run[q.pos[q.base[c] + q.fill[c] - 1]]), int(self.run[self.seed_pos[self.start[c]]]))

    def entries(self, chars: np.ndarray, own: bool, seeded: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """What is new in the queues of ``chars``, each followed by the character's seeds."""
        q, lcp = self.queues, None
        sizes = np.stack([(q.fill[chars] - self.done[chars]) * own, self.size[chars] * seeded], 1).ravel()
        starts = np.stack([q.base[chars] + self.done[chars], self.start[chars]], 1).ravel()
        if len(chars) == 1:
            (a, b), (n, m) = starts.tolist(), sizes.tolist()
            pos = np.concatenate([q.pos[a : a + n], self.seed_pos[b : b + m]])
            if q.lcp is not None:
                lcp = np.concatenate([q.lcp[a : a + n], self.seed_lcp[b : b + m]])
                if m:
                    lcp[n] = self.meet(chars[0])
            return pos, lcp
        which = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        at = np.arange(len(which)) - np.repeat(ends - sizes, sizes) + starts[which]
        seeds = (which & 1).astype(bool)
        pos = np.empty(len(at), np.int32)
        pos[~seeds], pos[seeds] = q.pos[at[~seeds]], self.seed_pos[at[seeds]]
        if q.lcp is not None:
            lcp = np.empty(len(at), np.int32)
            lcp[~seeds], lcp[seeds] = q.lcp[at[~seeds]], self.seed_lcp[at[seeds]]
            for k in np.flatnonzero(sizes[1::2]):
                lcp[ends[2 * k]] = self.meet(chars[k])
        return pos, lcp

    def targets(self, pos: np.ndarray) -> np.ndarray:
        before = pos[pos > 0] - 1
        return self.text[before[self.kind_l[before] == self.up]]

    def move(self, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        """Predecessors of the pass's kind go to the queues of their characters."""
        if not len(pos):
            return
        source = np.flatnonzero(pos > 0)
        before = pos[source] - 1
        good = self.kind_l[before] == self.up
        source, before = source[good], before[good]
        self.queues.put(self.text[before], before, source, _Minima(lcp) if lcp is not None else None, len(pos))

    def go(self) -> None:
        q = self.queues
        weight = np.diff(q.base) + self.size
        live = np.flatnonzero(weight)
        live = live if self.up else live[::-1]
        upto = np.cumsum(weight[live])
        step, i = max(128, int(STEP * len(self.text) ** 0.5)), 0
        while i < len(live):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + step, "right")))
            chars = live[i:j]
            if len(chars) > 1:
                pos, lcp = self.entries(chars, True, True)
                to = self.targets(pos)
                inside = to[(to >= chars.min()) & (to <= chars.max())]
                if len(inside):
                    # only characters before the first that still grows
                    grows = int(inside.min() if self.up else inside.max())
                    chars = chars[: np.searchsorted(chars, grows)] if self.up else chars[: np.searchsorted(-chars, -grows)]
                    pos, lcp = self.entries(chars, True, True) if len(chars) else (None, None)
                if len(chars):
                    self.move(pos, lcp)
                    self.done[chars] = q.fill[chars]
                    i += len(chars)
                    continue
                chars = live[i : i + 1]
            c = chars[0]
            while self.done[c] < q.fill[c]:
                pos, lcp = self.entries(chars, True, False)
                self.done[c] = q.fill[c]
                self.move(pos, lcp)
            self.move(*self.entries(chars, False, True))
            i += 1


def _kinds(text: np.ndarray) -> np.ndarray:
    """True for L. The last suffix is L: nothing is smaller than the end."""
    kind = np.ones(len(text), bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    if len(differs):
        larger = text[differs] > text[differs + 1]
        kind[: differs[-1] + 1] = np.repeat(larger, np.diff(np.concatenate(([-1], differs))))
    return kind


def _runs(text: np.ndarray) -> np.ndarray:
    """How often the character at each place repeats from there on."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    return (np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(len(text)) + 1).astype(np.int32)


def _induced(store: Store, text, kind_l, sigma: int, stars: np.ndarray, lcp: np.ndarray | None, run) -> tuple[_Queues, _Queues]:
    """L queues, ascending, and S queues, descending, that follow from the S* positions in this order."""
    counts = np.bincount(text, minlength=sigma)
    l_counts = np.bincount(text[kind_l], minlength=sigma)
    low = _Queues(store, l_counts, lcp is not None)
    # the last suffix follows from the end of the text, before all others of its character
    low.put(text[-1:], np.array([len(text) - 1], np.int32), np.array([0]), _Minima(np.zeros(1, np.int32)) if lcp is not None else None, 1)
    first = np.searchsorted(text[stars], np.arange(sigma + 1))
    _Pass(text, kind_l, low, first[:-1], np.diff(first), stars, lcp, True, run).go()
    high = _Queues(store, counts - l_counts, lcp is not None)
    total = int(low.base[-1])
    turned = None if lcp is None else np.concatenate((np.zeros(1, np.int32), low.lcp[:0:-1]))
    _Pass(text, kind_l, high, total - low.base[1:], l_counts, low.pos[::-1], turned, False, run).go()
    return low, high


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _sums(text: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over scattered characters, by which any two substrings compare."""
    x = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xCA9B0C7EBA1DA115)
    x ^= x >> np.uint64(29)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers[: len(text)])))


def _same(sums, powers, a, b, n) -> np.ndarray:
    """Whether the n characters from a and from b are equal: both sums are brought to the later one's power."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return (sums[low + n] - sums[low]) * powers[high - low] == sums[high + n] - sums[high]


def _common(sums, powers, pos: np.ndarray, n: int, cap: int) -> np.ndarray:
    """Common prefixes of neighbours in ``pos``, up to ``cap``."""
    a, b = pos[:-1].astype(np.int64), pos[1:].astype(np.int64)
    low, high = np.zeros(len(a), np.int64), np.minimum(n - np.maximum(a, b), cap)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = _same(sums, powers, a, b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return np.concatenate((np.zeros(min(1, len(pos)), np.int64), low)).astype(np.int32)


def _stars_sorted(store: Store, text: np.ndarray, kind_l: np.ndarray, sigma: int, sums, powers) -> np.ndarray:
    """S* positions in suffix order: substrings by induction, then names by recursion."""
    at = np.flatnonzero(kind_l[:-1] & ~kind_l[1:]).astype(np.int32) + 1
    if len(at) < 2:
        return at
    _, high = _induced(store, text, kind_l, sigma, at[np.argsort(text[at], kind="stable")], None, None)
    star = np.zeros(len(text), bool)
    star[at] = True
    s = _ascending(high)
    s = s[star[s]]
    size = np.full(len(text), -1, np.int32)
    size[at[:-1]] = np.diff(at) + 1
    n, a, b = size[s], s[:-1].astype(np.int64), s[1:].astype(np.int64)
    equal = (n[1:] == n[:-1]) & (n[1:] > 0)
    equal[equal] = _same(sums, powers, a[equal], b[equal], n[1:][equal].astype(np.int64))
    names = np.concatenate(([0], np.cumsum(~equal)))
    if names[-1] + 1 == len(s):
        return s
    place = np.zeros(len(text), np.int64)
    place[s] = names
    return at[suffixes(place[at], store=store)[0]]


def _ascending(high: _Queues) -> np.ndarray:
    """S suffixes ascending: characters ascend, each queue is turned."""
    at = np.arange(int(high.base[-1]))
    char = np.repeat(np.arange(len(high.fill)), np.diff(high.base))
    return high.pos[high.base[char] + high.base[char + 1] - 1 - at]


def suffixes(text: np.ndarray, cap: int | None = None, memory: int = 1 << 28, store: Store | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array of an array of small non-negative integers, and, where ``cap`` is given, common prefixes of neighbours.

    Common prefixes under ``cap`` are exact; a larger value says that at least ``cap`` characters are common.
    """
    if store is None:
        with Store(memory) as own:
            return suffixes(text, cap, memory, own)
    if not len(text):
        return np.zeros(0, np.int32), None if cap is None else np.zeros(0, np.int32)
    n, sigma = len(text), int(text.max()) + 1
    kind_l, powers = _kinds(text), _powers(n + 1)
    sums = _sums(text, powers)
    stars = _stars_sorted(store, text, kind_l, sigma, sums, powers)
    lcp, run = None, None
    if cap is not None:
        lcp, run = _common(sums, powers, stars, n, cap), _runs(text)
    del sums, powers
    low, high = _induced(store, text, kind_l, sigma, stars, lcp, run)
    base = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
    out = store.array(n, np.int32)
    char_l = np.repeat(np.arange(sigma), np.diff(low.base))
    at_l = np.arange(len(low.pos)) - low.base[char_l] + base[char_l]
    out[at_l] = low.pos
    char_s = np.repeat(np.arange(sigma), np.diff(high.base))
    at_s = base[char_s + 1] - 1 - (np.arange(len(high.pos)) - high.base[char_s])
    out[at_s] = high.pos
    if cap is None:
        return np.array(out), None
    common = np.zeros(n, np.int32)
    common[at_l] = low.lcp
    common[at_s[:-1]] = np.where(char_s[1:] == char_s[:-1], high.lcp[1:], 0)
    # the least S suffix of a character follows the largest L suffix of it
    both = np.flatnonzero((np.diff(low.base) > 0) & (np.diff(high.base) > 0))
    last_l, first_s = low.pos[low.base[both + 1] - 1], high.pos[high.base[both + 1] - 1]
    common[base[both] + np.diff(low.base)[both]] = np.minimum(run[last_l], run[first_s])
    return np.array(out), common
