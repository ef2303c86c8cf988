"""Near-duplicate passages by compact windows.

For each of ``HASHES`` hash functions the shingles of a text form a Cartesian tree by hash: node c with span l..r says that every
subsequence i..j with l <= i <= c <= j <= r has the shingle at c as its minimum. One such compact window stands for all of these
subsequences. Nodes whose span holds a passage are exactly the minima of passage-long windows, so the tree is built of those alone.

1. Windows meet by function and minimum. Windows with the same shingles around their minimum are one class of copies at once, and so
   are windows with the same passages as sets, where texts repeat themselves.
2. Of each class one window brings its interval of shingles. Intervals that meet are joined on their minimum: those of which no passage
   can have enough shingles in common with the others go first, by counts; the rest are verified by the exact similarity of passages
   of ``PASSAGE`` words that hold the minimum, inside both windows, and links are followed until no class is left to ask.
3. A document comes back with the first document of each class that its passages belong to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, plain_words, table
from .components import components

SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
#: Shingles of a passage.
T = PASSAGE - SHINGLE + 1
#: Passages with similarity 0.8 agree in a function with probability 0.8, in one of three with 0.992; equal passages agree in all.
HASHES = 3
#: Shingles that passages without repeats share where their similarity is 0.8.
NEED = math.ceil(2 * T * SIMILAR / (1 + SIMILAR))
#: Different windows of one minimum that one task compares; of more, chunks are compared pair by pair.
CROWD = 100_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word shingles of all texts in order, a zero after each text, and the place of each text's first shingle."""
    import xxhash

    digest, one, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        w = plain_words(t)
        one += map(digest, w)
        sizes.append(len(w))
    one, sizes = np.array(one, np.uint64), np.array(sizes, np.int64)
    n = np.maximum(sizes - SHINGLE + 1, 0)
    ends = np.cumsum(n + 1)
    begin = ends - n - 1
    word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    s = np.zeros(len(word), np.uint64)
    for i in range(SHINGLE):
        s = (s ^ one[word + i]) * np.uint64(_ODD[0])
        s ^= s >> np.uint64(29)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    out[np.delete(np.arange(len(out)), ends - 1)] = np.maximum(s, 1)
    return out, begin


def shingles(text: str | None) -> np.ndarray:
    return joined([text])[0][:-1]


def mixed(s: np.ndarray, function: int) -> np.ndarray:
    """A function's hashes; zeros, which part texts, stay the least."""
    x = (s ^ np.uint64(_ODD[function])) * np.uint64(_ODD[1])
    x ^= x >> np.uint64(31)
    x *= np.uint64(_ODD[2])
    return np.where(s == 0, np.uint64(0), np.maximum(x ^ x >> np.uint64(32), 1))


def compact_windows(h: np.ndarray, t: int = T) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes whose span is t or longer; of equal hashes the first is the smaller."""
    if len(h) < t:
        return (np.zeros(0, np.int64),) * 3
    pad = np.concatenate((h, np.full(-len(h) % t, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, t)
    m = len(h) - t + 1
    least = np.minimum(np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()[:m], np.minimum.accumulate(pad, axis=1).ravel()[t - 1 : t - 1 + m])
    begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    nodes = begin + (np.lib.stride_tricks.sliding_window_view(h, t)[begin] == least[begin, None]).argmax(axis=1)
    # equal minima one after another: the later place counts once the earlier has left the window
    more = [nodes]
    while True:
        nxt = more[-1] + 1
        ok = nxt < m
        start = nxt[ok]
        start = start[least[start] == h[more[-1][ok]]]
        if not len(start):
            break
        more.append(start + (np.lib.stride_tricks.sliding_window_view(h, t)[start] == least[start, None]).argmax(axis=1))
    c = np.unique(np.concatenate(more))
    left, right, stack, values, places = [0] * len(c), [len(h) - 1] * len(c), [], h[c].tolist(), c.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return np.array(left, np.int64), c, np.array(right, np.int64)


def _reach(left, c, right) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a passage which holds c may have: of the window, T - 1 to either side."""
    return np.maximum(left, c - T + 1), np.minimum(right, c + T - 1)


def _before(s: np.ndarray) -> np.ndarray:
    """Place at which each shingle stood last, -1 for none."""
    out, order = np.full(len(s), -1, np.int64), np.argsort(s, kind="stable")
    same = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def passages(s: np.ndarray, before: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reaches in which a shingle stands twice, and for each a hash of its passages, as sets of sets.

    Where a text repeats a word or a line, reaches move on place by place and hold the same sets all along. Their similarity to any
    other is the same, so they are copies of one another.
    """
    odd, out = [], []
    for a in range(0, len(lo), 1024):
        own = np.arange(a, min(a + 1024, len(lo)))
        at = lo[own, None] + np.arange(2 * T - 1)
        inside = at <= hi[own, None]
        at = np.minimum(at, len(s) - 1)
        last = np.where(inside, before[at] - lo[own, None], -1)
        real = (last >= 0).any(axis=1)
        own, last, inside, value = own[real], last[real], inside[real], mixed(s[at[real]], 0)
        sets = np.zeros((len(own), T), np.uint64)
        for i in range(T):
            sets[:, i] = np.where(inside[:, i + T - 1], (value[:, i : i + T] * (last[:, i : i + T] < i)).sum(axis=1, dtype=np.uint64), 0)
        sets.sort(axis=1)
        sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = 0
        odd.append(own)
        out.append(mixed(sets, 1).sum(axis=1, dtype=np.uint64))
    return np.concatenate([np.zeros(0, np.int64), *odd]), np.concatenate([np.zeros(0, np.uint64), *out])


_ROW = pa.schema([("k", pa.int64()), ("e", pa.int64()), ("d", pa.int64()), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _windows(docs: DataFrame) -> DataFrame:
    """A row for each compact window: function and minimum k, shingles within reach e, document d, minimum c, reach lo..hi."""

    def task(batches):
        up, down = (np.full(1 << 20, x, np.uint64) for x in (_ODD[0], pow(_ODD[0], -1, 2**64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        for batch in batches:
            for part in _pieces(batch):
                s, begin = joined(part.column("text").to_pylist())
                d = part.column("d").to_numpy()
                # prefix sums restart where the powers end; a reach is far shorter than that
                power = np.arange(len(s)) & (len(up) - 1)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s * up[power])))
                cols, before = [[] for _ in range(6)], _before(s)
                close = np.concatenate(([0], np.cumsum(before >= np.arange(len(s)) - 2 * T)))
                for f in range(HASHES):
                    h = mixed(s, f)
                    left, c, right = compact_windows(h)
                    real = s[c] != 0
                    left, c, right = left[real], c[real], right[real]
                    lo, hi = _reach(left, c, right)
                    doc = np.searchsorted(begin, c, "right") - 1
                    e = (sums[hi + 1] - sums[lo]) * down[power[lo]]
                    # a reach over the seam is summed by itself
                    for i in np.flatnonzero(power[lo] > power[hi]):
                        e[i] = (s[lo[i] : hi[i] + 1] * up[: hi[i] + 1 - lo[i]]).sum(dtype=np.uint64)
                    e ^= (hi - lo).astype(np.uint64) << np.uint64(8) | (c - lo).astype(np.uint64)
                    again = np.flatnonzero(close[hi + 1] > close[lo + 1])
                    _, some, same = np.unique(e[again], return_index=True, return_inverse=True)
                    odd, sets = passages(s, before, lo[again[some]], hi[again[some]])
                    kinds = e[again[some]]
                    kinds[odd] = sets
                    e[again] = kinds[same]
                    first = begin[doc]
                    for col, x in zip(cols, (h[c].view(np.int64), e.view(np.int64), d[doc], (c - first).astype(np.int32), (lo - first).astype(np.int32), (hi - first).astype(np.int32))):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], schema=_ROW)

    return docs.mapInArrow(task, "k long, e long, d long, c int, lo int, hi int")


def _pieces(batch: pa.RecordBatch, most: int = 2 << 20):
    """Parts of a batch with so many bytes of text each, or one longer text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    i, total = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if j > i and total + n > most:
            yield batch.slice(i, j - i)
            i, total = j, 0
        total += n
    if len(sizes) > i:
        yield batch.slice(i)


def alike(a: np.ndarray, ca: int, b: np.ndarray, cb: int, t: int = T) -> float:
    """Greatest Jaccard similarity of a passage of t shingles of a and one of b, each holding its text's minimum."""
    best = 0.0
    sets = [[set(x[i : i + t].tolist()) for i in range(max(0, c - t + 1), min(c, len(x) - t) + 1)] for x, c in ((a, ca), (b, cb))]
    for x in sets[0]:
        for y in sets[1]:
            both = len(x & y)
            best = max(best, both / (len(x) + len(y) - both))
    return best


def grids(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts (their shingles one after another, from 1) as rows by distance from the minimum, which stands ``at`` a place; 0 outside."""
    out = np.zeros((len(sizes), 2 * T - 1), np.int32)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes - (T - 1 - at), sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = flat
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """How many places of each passage are true; passage i are the places from i on."""
    sums = np.zeros((len(x), 2 * T), np.uint8)
    np.cumsum(x, axis=1, dtype=np.uint8, out=sums[:, 1:])
    return sums[:, T:] - sums[:, :-T]


class Texts:
    """Texts around minima, on grids. Groups of texts that share a minimum are handled side by side, not one after another."""

    def __init__(self, grid: np.ndarray):
        self.grid = self.once = grid
        value = np.sort(grid, axis=1)
        self.repeats = ((value[:, 1:] == value[:, :-1]) & (value[:, 1:] > 0)).any(axis=1)
        #: Different shingles of each passage, 0 where it leaves the text, and of the passage with fewest.
        self.sizes = np.where(_sums(grid > 0) == T, T, 0).astype(np.int16)
        if self.repeats.any():
            odd = np.flatnonzero(self.repeats)
            order = np.argsort(grid[odd], axis=1, kind="stable")
            value = np.take_along_axis(grid[odd], order, 1)
            row, nth = np.nonzero((value[:, 1:] == value[:, :-1]) & (value[:, 1:] > 0))
            before = np.full((len(odd), 2 * T - 1), -1, np.int16)
            before[row, order[row, nth + 1]] = order[row, nth]
            for i in range(T):
                self.sizes[odd, i] = np.where(self.sizes[odd, i] > 0, (before[:, i : i + T] < i).sum(axis=1), 0)
            self.once = grid.copy()
            self.once[odd] = np.where(before < 0, grid[odd], 0)
        self.least = np.where(self.sizes > 0, self.sizes, T).min(axis=1)

    def candidates(self, group: np.ndarray) -> np.ndarray:
        """Texts with a passage of which enough shingles stand in another text of their group, in a time that grows with the rows.

        Shingles are counted in cells by hash; two that share a cell let a text through that the comparison then dismisses.
        """
        bits = max(16, int(self.grid.size).bit_length() + 1)
        cell = (group.astype(np.uint64)[:, None] << np.uint64(31) ^ self.once.astype(np.uint64)) * np.uint64(_ODD[0]) >> np.uint64(64 - bits)
        seen = np.bincount(cell[self.once > 0].astype(np.int64), minlength=1 << bits) > 1
        # a repeat counts as its first
        cell = (group.astype(np.uint64)[:, None] << np.uint64(31) ^ self.grid.astype(np.uint64)) * np.uint64(_ODD[0]) >> np.uint64(64 - bits)
        odd = np.zeros(int(group.max()) + 1, bool)
        odd[group[self.repeats]] = True
        enough = np.where(odd[group][:, None], SIMILAR * self.sizes, NEED) - 1e-9
        return np.flatnonzero(((_sums(seen[cell.astype(np.int64)] & (self.grid > 0)) >= enough) & (self.sizes > 0)).any(axis=1))

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of texts whether any passage of the one is similar to any passage of the other."""
        near = np.zeros(len(i), bool)
        for a in range(0, len(i), 2048):
            x, y = i[a : a + 2048], j[a : a + 2048]
            # texts without repeats: what agrees place by place is a set of as many shingles
            sure = (_sums((self.grid[x] == self.grid[y]) & (self.grid[x] > 0)).max(axis=1) >= NEED) & ~(self.repeats[x] | self.repeats[y])
            rest = np.flatnonzero(~sure)
            near[a : a + 2048] = sure
            both = np.sort(np.concatenate((self.once[x[rest]], self.once[y[rest]]), axis=1), axis=1)
            both = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(axis=1)
            p, q = self.least[x[rest]], self.least[y[rest]]
            rest = rest[both >= np.maximum(SIMILAR * np.maximum(p, q), SIMILAR / (1 + SIMILAR) * (p + q)) - 1e-9]
            for b in range(0, len(rest), 64):
                some = rest[b : b + 64]
                near[a + some] = self._compared(x[some], y[some])
        return near

    def _compared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same by the sets of all passages: a bit for each different shingle of a pair."""
        cells = np.concatenate((self.grid[i], self.grid[j]), axis=1)
        order = np.argsort(cells, axis=1)
        value = np.take_along_axis(cells, order, 1)
        slot = np.empty_like(order)
        np.put_along_axis(slot, order, np.cumsum(np.diff(value, axis=1, prepend=value[:, :1]) != 0, axis=1), 1)
        bits = np.zeros((*cells.shape, 3), np.uint64)  # at most 182 different ones
        for word in range(3):
            here = (slot >> 6 == word) & (cells > 0)
            bits[..., word][here] = np.uint64(1) << (slot[here] & 63).astype(np.uint64)
        sets = []
        for out in (bits[:, : 2 * T - 1], bits[:, 2 * T - 1 :]):
            width = 1
            while 2 * width <= T:
                out = out[:, :-width] | out[:, width:]
                width *= 2
            sets.append(out[:, :T] | out[:, T - width : 2 * T - width])
        both = np.bitwise_count(sets[0][:, :, None] & sets[1][:, None]).sum(axis=3, dtype=np.int32)
        x, y = self.sizes[i][:, :, None], self.sizes[j][:, None]
        return ((both >= SIMILAR * (x + y - both) - 1e-9) & (x > 0) & (y > 0)).any(axis=(1, 2))

    def roots(self, group: np.ndarray) -> np.ndarray:
        """For each text the first one of its group that links of similar passages reach; groups are numbers that ascend.

        In each round one text of every group asks all of its group that no link has reached yet, so a group of copies takes one
        round, and each link between classes is found wherever words came in, went or moved.
        """
        root, state = np.arange(len(group)), np.zeros(len(group), np.int8)  # free, asks, done
        live = self.candidates(group) if len(group) else root
        while len(live):
            own, st, place = group[live], state[live], np.arange(len(live))
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(np.append(heads, len(live)))
            asks, free = (np.minimum.reduceat(np.where(st == x, place, len(live)), heads) for x in (1, 0))
            who = np.where(asks < len(live), asks, np.minimum(free, len(live) - 1))
            st[who] = 2
            others = np.flatnonzero(st == 0)
            i, j = live[np.repeat(who, size)[others]], live[others]
            near = self.similar(i, j)
            root[j[near]] = root[i[near]]
            st[others[near]] = 1
            state[live] = st
            live = live[(st < 2) & np.repeat(np.add.reduceat((st == 0).astype(np.int64), heads) > 0, size)]
        return root


def classes(texts: list[np.ndarray], at: list[int]) -> list[int]:
    """For each text of one group (shingles around its minimum ``at``) the first one that links of similar passages reach."""
    grid = grids(np.concatenate(texts), np.array([len(x) for x in texts]), np.array(at))
    return Texts(grid).roots(np.zeros(len(texts), np.int64)).tolist()


def _reaches(s: np.ndarray) -> np.ndarray:
    """31 bits of each shingle, from 1."""
    return np.maximum(s >> np.uint64(33), 1).astype(np.int32)


def _classes(ws: Workspace, docs: DataFrame, met: DataFrame, crowd: int) -> DataFrame:
    """(k, e, root): classes of copies whose minimum met another, and the class that stands for what they reach.

    ``met`` has in ``kinds`` how many classes of copies share the minimum. Of more than ``crowd`` each pair of chunks is compared in a
    task of its own, and what the tasks link comes together as components.
    """
    lists = met.groupBy("d").agg(F.collect_list(F.struct("k", "e", "c", "lo", "hi", "kinds")).alias("windows")).withColumnRenamed("d", "d2")
    names = ("k", "b", "m", "e", "c", "s")
    brought = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))))
    linked = pa.schema([(x, pa.int64()) for x in ("k", "e", "root", "m")])

    def bring(batches):
        for batch in batches:
            for part in _pieces(batch):
                s, begin = joined(part.column("text").to_pylist())
                windows = part.column("windows")
                own = windows.flatten()
                k, e, c, lo, hi, kinds = (own.field(x).to_numpy() for x in ("k", "e", "c", "lo", "hi", "kinds"))
                first = np.repeat(begin, pa.compute.list_value_length(windows).to_numpy())
                m = -(-kinds // crowd)
                chunk = (e.view(np.uint64) % m.astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(k)), m)
                other = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                block = np.minimum(chunk[row], other) * m[row] + np.maximum(chunk[row], other)
                size = (hi - lo + 1).astype(np.int64)[row]
                at = np.arange(size.sum()) + np.repeat((first + lo)[row] - (np.cumsum(size) - size), size)
                ends = np.concatenate(([0], np.cumsum(4 * size))).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(_reaches(s[at]))])
                yield pa.RecordBatch.from_arrays([*map(pa.array, (k[row], block, m[row], e[row], (c - lo)[row])), texts], schema=brought)

    def shard(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        k, block, m, e, c = (np.concatenate([b.column(x).to_numpy() for b in parts]) for x in names[:5])
        flat, sizes = [], []
        for b in parts:
            texts = b.column("s")
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            flat.append(np.frombuffer(texts.buffers()[2], np.int32)[ends[0] // 4 : ends[-1] // 4])
            sizes.append(np.diff(ends) // 4)
        grid = grids(np.concatenate(flat), np.concatenate(sizes), c.astype(np.int64))
        order = np.lexsort((e, block, k))
        k, block, m, e = k[order], block[order], m[order], e[order]
        group = np.cumsum(np.concatenate(([False], (k[1:] != k[:-1]) | (block[1:] != block[:-1]))))
        root = Texts(grid[order]).roots(group)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (k, e, e[root], m))], schema=linked)

    spark = docs.sparkSession
    rows = met.agg(F.sum(F.ceil(F.col("kinds") / crowd))).first()[0] or 0
    cuts = docs.join(lists, docs["d"] == lists["d2"]).select("text", "windows").mapInArrow(bring, "k long, b long, m long, e long, c int, s binary")
    cuts = cuts.repartition(partitions(spark, rows, 20_000), "k", "b")
    found = ws.save(cuts.mapInArrow(shard, "k long, e long, root long, m long"), "linked")
    out, crowded = found.where("m = 1").select("k", "e", "root"), found.where("m > 1")
    if not crowded.isEmpty():
        node = crowded.select("k", "e", F.xxhash64("k", "e").alias("a"), F.xxhash64("k", "root").alias("b"))
        reach = components(ws, node.select("a", "b"))
        node = node.select("k", "e", "a").distinct().join(reach, F.col("a") == F.col("node"), "left")
        out = out.unionByName(node.select("k", "e", F.coalesce(reach["root"], "a").alias("root")))
    return out


def near_passages(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Passages of whole texts that occur elsewhere with a similarity of ``SIMILAR`` or more.

    doc_id, class_doc_id (the smallest document of the class that the passage belongs to), start (first word), n_words, n_windows
    (compact windows that say so, over all functions). A document has a row for each class document; its own identifier marks the
    class's first document. What a document repeats itself alone is no class, nor are rows that repeat identifier and text. Null and
    empty texts, and those of fewer than ``PASSAGE`` words, have no passage. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("d", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))
    found = ws.save(_windows(docs), "windows")
    # most minima occur once; only the others go on
    more = found.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    found = ws.save(found.join(more, "k", "left_semi"), "met-windows")
    ws.drop("windows")
    kinds = ws.save(found.groupBy("k", "e").agg(F.count("*").alias("n"), F.min(F.struct("d", "c", "lo", "hi")).alias("rep"), F.max("d").alias("last")), "kinds")
    several = kinds.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1")
    met = ws.save(kinds.join(several, "k").select("k", "e", "rep.*", "kinds"), "met")
    linked = _classes(ws, docs.dropDuplicates(["d"]), met, crowd)
    kinds = kinds.join(linked, ["k", "e"], "left").withColumn("root", F.coalesce("root", "e"))
    size = kinds.groupBy("k", "root").agg(F.min("rep.d").alias("a"), F.max("last").alias("b")).where("a <> b").select("k", "root")
    kinds = kinds.join(size, ["k", "root"]).select("k", "e", "root")
    own = found.join(kinds, ["k", "e"]).select("k", "root", "d", "lo", "hi")
    names = docs.select("d", "doc_id")
    own = ws.save(own.join(names.distinct(), "d"), "members")
    first = own.groupBy("k", "root").agg(F.min("doc_id").alias("class_doc_id"))
    out = own.join(first, ["k", "root"])
    return out.groupBy("doc_id", "class_doc_id").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + SHINGLE).alias("n_words"), F.count("*").alias("n_windows"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of all ``documents``."""
    with Workspace(spark, "op8") as ws:
        return ws.result(near_passages(ws, table(spark, sf_dir, "documents")))
