"""Exact substring dedup: bytes of strings of ``LENGTH`` bytes that start at two places or more.

1. *Anchors.* The least hash of the ``gram(LENGTH)``-byte strings in a window of ``LENGTH`` bytes depends on the window alone, so equal
   windows have equal anchors. Consecutive windows with one anchor are a run. Runs with equal bytes (by 128 bits: the anchor's hash and
   XXH3 of the bytes) fall together in an aggregation that keeps counts alone; a run whose anchor is met nowhere else is done with.
2. *Shards.* What is left, each different run of an anchor once, goes to a shard by its anchor. Windows whose surroundings of the
   anchor no other run has are left out (``narrowed``). The rest of a shard is suffix-sorted by external
   induced sorting, and neighbours among its windows that have ``LENGTH`` bytes in common are repeats. Anchors are sorted in groups
   of some megabytes; one anchor's runs are never apart, so a shard may be far larger: queues and arrays beyond ``MEMORY`` bytes each
   are files of the task's scratch.
3. *Crowded anchors.* An anchor with very many different runs is dealt anew: windows at 32 (then 4, then 1) consecutive distances
   from the anchor share a core of bytes, which is their key in another round of the same.
4. Spans come together by document and are cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, table, tidy
from .induced import suffixes

LENGTH = 400
#: Length of what repeats in the pipeline's stage: passages of over 50 words, which have 200 bytes even at four bytes a word.
PASSAGE = 200
#: Different runs of one anchor that a shard sorts; of more, the runs are dealt anew by the next number of distances.
CROWD, BLOCKS = 4096, (32, 4, 1)
#: Distances from the anchor that share a core, for leaving out windows without a partner.
CORE = 16
#: Bytes that are suffix-sorted at once where anchors allow it, and runs for each task.
SORTED, RUNS = 3 << 19, 6000
#: Bytes that each array of a sort may have in memory; larger ones are mapped files.
MEMORY = 1 << 26
RUN = "doc_id long, th long, first int, n int, h long, ch long, known boolean"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram(length: int) -> int:
    """Bytes of the strings whose least hash is a window's anchor."""
    return max(1, 2 * length // 5)


class Hasher:
    """Hashes of substrings of one text from prefix sums of a polynomial, by scattered bytes."""

    _table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, b: np.ndarray):
        if len(Hasher._up) <= len(b):
            n = max(2 * len(Hasher._up), len(b) + 1)
            for name, odd in (("_up", int(_ODD)), ("_down", pow(int(_ODD), -1, 2**64))):
                x = np.full(n, odd, np.uint64)
                x[0] = 1
                setattr(Hasher, name, np.cumprod(x))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self._table[b] * self._up[: len(b)])))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of bytes a..b-1."""
        return self._mixed((self.sums[b] - self.sums[a]) * self._down[a])

    def grams(self, n: int) -> np.ndarray:
        return self._mixed((self.sums[n:] - self.sums[:-n]) * self._down[: len(self.sums) - n])

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    pad = np.concatenate((x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


def _places(x: np.ndarray, at: np.ndarray, w: int, first: bool) -> np.ndarray:
    """Place of the first or last least value of the windows that start at ``at``."""
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), 4096):
        own = at[i : i + 4096]
        part = np.lib.stride_tricks.sliding_window_view(x, w)[own]
        out[i : i + 4096] = own + (part.argmin(axis=1) if first else w - 1 - part[:, ::-1].argmin(axis=1))
    return out


def _digests(b: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """XXH3 of the bytes of each run."""
    import xxhash

    raw, digest = memoryview(b), xxhash.xxh3_64_intdigest
    return np.array([digest(raw[i:j]) for i, j in zip(first.tolist(), (first + n - 1 + length).tolist())], np.uint64)


def _equal(b: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at i and at j have the same bytes."""
    at, out = np.lib.stride_tricks.sliding_window_view(b, length), np.empty(len(i), bool)
    for k in range(0, len(i), 4096):
        out[k : k + 4096] = (at[i[k : k + 4096]] == at[j[k : k + 4096]]).all(axis=1)
    return out


def runs(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, hash of the bytes, whether known) of each run of a text.

    Where a text repeats itself its anchor stands at several places of one run, which may be as long as the text. Windows that such a
    run has twice, compared byte by byte, are *known* to be repeats, and come as runs of their own; of each different window the first
    one stays as a partner for other texts. All other runs have at most ``length - gram(length) + 1`` windows.
    """
    w, hasher = length - gram(length) + 1, Hasher(b)
    h = hasher.grams(gram(length))
    least = _window_minima(h, w)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.append(first, len(least)))
    again = _places(h, first, w, True) != _places(h, first + n - 1, w, False)
    key, known = least[first], np.zeros(len(first), bool)
    if again.any():
        parts = [(first[~again], n[~again], key[~again], known[~again])]
        for f, m, k in zip(first[again].tolist(), n[again].tolist(), key[again].tolist()):
            at = np.arange(f, f + m)
            _, once, inverse, count = np.unique(hasher.of(at, at + length), return_index=True, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(count[inverse] > 1)
            later = twice[once[inverse[twice]] != twice]
            later = later[_equal(b, at[later], at[once[inverse[later]]], length)]
            twice = np.union1d(later, once[inverse[later]])
            for places, sure in ((np.sort(once), False), (twice, True)):
                if len(places):
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(places) > 1)))
                    parts.append((f + places[cut], np.diff(np.append(cut, len(places))), np.full(len(cut), k, np.uint64), np.full(len(cut), sure)))
        first, n, key, known = (np.concatenate(x) for x in zip(*parts))
    return first, n, key, _digests(b, first, n, length), known


def dealt(b: np.ndarray, first: int, n: int, block: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The windows of one run as runs of ``block`` distances from the anchor; keys are hashes of the core that such windows share."""
    part = b[first : first + n - 1 + length]
    w, hasher = length - gram(length) + 1, Hasher(part)
    h = hasher.grams(gram(length))
    at = np.arange(n)
    anchor = _places(h, at, w, True)
    group = (anchor - at) // block
    cut = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (anchor[1:] != anchor[:-1]))))
    size = np.diff(np.append(cut, n))
    core = anchor[cut] - group[cut] * block
    key = hasher.of(core, core + length - block + 1) + group[cut].astype(np.uint64) * _ODD
    return cut + first, size, key, _digests(part, cut, size, length), np.zeros(len(cut), bool)


def repeats(texts: list[bytes], windows: list[int], length: int = LENGTH, memory: int = MEMORY) -> list[np.ndarray]:
    """For each text whether its first windows, ``windows`` of them, occur at another of all these windows. By suffix order."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", "u1").astype(np.int32) + 1
    ends = np.cumsum(sizes)
    raw[ends - 1] = 0
    asked = np.zeros(len(raw) + 1, np.int32)
    np.add.at(asked, ends - sizes, 1)
    np.add.at(asked, ends - sizes + np.array(windows), -1)
    asked = np.cumsum(asked[:-1]).astype(bool)
    order, common = suffixes(raw, cap=length, memory=memory)
    own = np.flatnonzero(asked[order])
    near = np.zeros(len(own) + 1, bool)
    if len(own) > 1:
        # the least common prefix from one asked place to the next
        near[1:-1] = np.minimum.reduceat(common, np.append(own[:-1] + 1, len(common) - 1))[:-1] >= length if own[-1] == len(common) - 1 else np.minimum.reduceat(common, own + 1)[:-1] >= length
    found = np.zeros(len(raw), bool)
    found[order[own]] = near[:-1] | near[1:]
    return [found[a : a + w] for a, w in zip((ends - sizes).tolist(), windows)]


def narrowed(texts: list[bytes], windows: np.ndarray, keys: np.ndarray, single: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) for each run, ordered by anchor: its windows outside low..high-1 have no partner under the anchor, so they are not sorted.

    Equal windows stand at one distance from the anchor. Windows at ``CORE`` distances one after another share a core of bytes; where no
    other run has that core there, or none of those with it is single, there is nothing to find. An anchor that stands
    in a run at other than one place (or whose key is a core's) keeps all its runs.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin, step = np.cumsum(sizes) - sizes, max(1, min(CORE, (length - gram(length) + 1) // 4))
    hasher = Hasher(np.frombuffer(b"".join(texts), "u1"))
    found = hasher.grams(gram(length))
    own = np.repeat(np.arange(len(texts)), sizes)[: len(found)]
    at = np.flatnonzero(found == keys[own])
    at = at[at + gram(length) <= (begin + sizes)[own[at]]]
    place = np.zeros(len(texts), np.int64)
    place[own[at]] = at - begin[own[at]]
    group = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    free = np.bincount(group, np.bincount(own[at], minlength=len(texts)) != 1)[group] > 0
    least, most = (place - windows + 1) // step, place // step
    n = np.where(free, 0, most - least + 1)
    row = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + least[row]
    start = begin[row] + place[row] - k * step
    core = hasher.of(start, start + length + 1 - step) + (group[row] * (length + 1) + k).astype(np.uint64) * _ODD
    _, kind, count = np.unique(core, return_inverse=True, return_counts=True)
    good = (count > 1) & (np.bincount(kind, single[row], minlength=len(count)) > 0)
    met = np.flatnonzero(good[kind]) if len(row) else np.zeros(0, np.int64)
    low, high = np.zeros(len(texts), np.int64), np.where(free, windows, 0)
    # a run's distances ascend, so its windows descend; the last one written is the outermost
    high[row[met][::-1]] = np.minimum(windows[row[met]], place[row[met]] - k[met] * step + 1)[::-1]
    low[row[met]] = np.maximum(0, place[row[met]] - k[met] * step - step + 1)
    return low, high


def _spans(found: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Byte spans of the windows that are found, windows counting from ``first``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_RUN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("ch", pa.int64()), ("known", pa.bool_())])
_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _found_runs(docs: DataFrame, length: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            ids, th, texts = batch.column("doc_id"), batch.column("th"), batch.column("text")
            for i in range(0, len(batch), 128):
                cols = [[] for _ in range(7)]
                for d, t, text in zip(ids.slice(i, 128).to_pylist(), th.slice(i, 128).to_pylist(), texts.slice(i, 128).to_pylist()):
                    b = np.frombuffer(_bytes(text), "u1")
                    if len(b) >= length:
                        _put(cols, d, t, runs(b, length))
                if cols[0]:
                    yield _run_batch(cols)

    return docs.mapInArrow(tidy(task), RUN)


def _put(cols: list[list], doc: int | None, th: int, own: tuple[np.ndarray, ...]) -> None:
    cols[0].append(pa.array([doc] * len(own[0]), pa.int64()))
    for c, x in zip(cols[1:], (np.full(len(own[0]), th, np.int64), own[0].astype(np.int32), own[1].astype(np.int32), own[2].view(np.int64), own[3].view(np.int64), own[4])):
        c.append(x)


def _run_batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(cols[0]), *(pa.array(np.concatenate(c)) for c in cols[1:])], schema=_RUN)


def _with_runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents that have wanted runs, with the list of them; a document's runs are no more than its bytes."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n", "h", "single")).alias("runs"))
    lists = lists.withColumnsRenamed({"doc_id": "d2", "th": "t2"})
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["d2"]) & (docs["th"] == lists["t2"])).select("doc_id", "th", "text", "runs")


def _dealt_runs(docs: DataFrame, wanted: DataFrame, block: int, length: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            for i in range(0, len(batch), 64):
                cols = [[] for _ in range(7)]
                for r in batch.slice(i, 64).to_pylist():
                    b = np.frombuffer(_bytes(r["text"]), "u1")
                    for x in r["runs"]:
                        _put(cols, r["doc_id"], r["th"], dealt(b, x["first"], x["n"], block, length))
                if cols[0]:
                    yield _run_batch(cols)

    return _with_runs(docs, wanted).mapInArrow(tidy(task), RUN)


def _sorted_spans(docs: DataFrame, wanted: DataFrame, length: int, memory: int) -> DataFrame:
    """Spans of single runs that occur at another window of their anchor, by suffix-sorting shards of anchors."""
    cut = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("single", pa.bool_()), ("bytes", pa.binary())])

    def bring(batches):
        for batch in batches:
            for i in range(0, len(batch), 64):
                rows = []
                for r in batch.slice(i, 64).to_pylist():
                    b = _bytes(r["text"])
                    rows += [(x["h"], r["doc_id"], r["th"], x["first"], x["n"], x["single"], b[x["first"] : x["first"] + x["n"] - 1 + length]) for x in r["runs"]]
                yield _batch(rows, cut)

    def shard(batches):
        parts = list(batches)
        if not parts:
            return
        whole = pa.Table.from_batches(parts).sort_by("h")
        h = whole.column("h").to_numpy()
        size = pa.compute.binary_length(whole.column("bytes")).to_numpy().astype(np.int64)
        heads = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))

        def ordered(held: list[tuple]):
            rows = []
            for (doc, th, first, single, _, _), found in zip(held, repeats([x[4] for x in held], [x[5] for x in held], length, memory)):
                if single and found.any():
                    rows += [(doc, th, a, b) for a, b in _spans(found, first, length)]
            if rows:
                yield _batch(rows, _SPAN)

        i, held, total = 0, [], 0
        while i < len(heads) - 1:
            j, read = i + 1, size[heads[i] : heads[i + 1]].sum()
            while j < len(heads) - 1 and read + (more := size[heads[j] : heads[j + 1]].sum()) <= SORTED:
                j, read = j + 1, read + more
            own = whole.slice(heads[i], heads[j] - heads[i]).to_pydict()
            low, high = narrowed(own["bytes"], np.array(own["n"]), h[heads[i] : heads[j]].view(np.uint64), np.array(own["single"]), length)
            new = [(own["doc_id"][k], own["th"][k], own["first"][k] + a, own["single"][k], own["bytes"][k][a : z - 1 + length], z - a) for k, (a, z) in enumerate(zip(low.tolist(), high.tolist())) if a < z]
            more = sum(len(x[4]) for x in new)
            if held and total + more > SORTED:
                yield from ordered(held)
                held, total = [], 0
            held, total, i = held + new, total + more, j
        if held:
            yield from ordered(held)

    n = partitions(docs.sparkSession, wanted.count(), RUNS)
    cuts = _with_runs(docs, wanted).mapInArrow(tidy(bring), "h long, doc_id long, th long, first int, n int, single boolean, bytes binary")
    return cuts.repartition(n, "h").mapInArrow(tidy(shard), "doc_id long, th long, a int, b int")


def repeated_spans(ws: Workspace, docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, memory: int = MEMORY) -> DataFrame:
    """(doc_id, th, a, b): byte spans, which may overlap, that strings of ``length`` bytes cover which start at another place too.

    ``docs``: doc_id, th (hash of the text), text; rows that repeat both are places of their own and share their spans.
    """
    found = ws.save(_found_runs(docs, length), "runs")
    span = ("doc_id", "th", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + length).alias("b"))
    out, found = [found.where("known").select(*span)], found.where("not known")
    for level, block in enumerate((*BLOCKS, None)):
        kinds = found.groupBy("h", "ch").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "first", "n")).alias("rep"))
        kinds = ws.save(kinds, f"kinds-{level}")
        out.append(ws.save(found.join(kinds.where("c > 1").select("h", "ch"), ["h", "ch"]).select(*span), f"twice-{level}"))
        # an anchor matters while it has different runs, one of them single
        by_anchor = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("least = 1 and kinds > 1")
        wanted = kinds.join(by_anchor.select("h", "kinds"), "h").select("rep.*", "h", (F.col("c") == 1).alias("single"), "kinds")
        wanted = ws.save(wanted, f"wanted-{level}")
        few = wanted if block is None else wanted.where(F.col("kinds") <= crowd)
        out.append(ws.save(_sorted_spans(docs, few, length, memory), f"sorted-{level}"))
        rest = wanted.where(F.col("kinds") > crowd)
        if block is None or rest.isEmpty():
            break
        found = ws.save(_dealt_runs(docs, rest, block, length), f"dealt-{level}")
    spans = out[0]
    for x in out[1:]:
        spans = spans.unionByName(x)
    return spans


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(b: bytes, cut: list[tuple[int, int]]) -> bytes:
    return b"".join(b[a:z] for a, z in zip([0, *(x[1] for x in cut)], [*(x[0] for x in cut), len(b)]))


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All documents with all their columns, and ``__spans``: the different spans of a document, no more than its bytes."""
    lists = spans.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_set(F.struct("a", "b")).alias("__spans"))
    return docs.join(lists, docs["doc_id"].eqNullSafe(F.col("__d")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__t")), "left").drop("__d", "__t")


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. Null and empty texts have no bytes. Extra columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def task(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = []
                for r in batch.slice(i, 256).to_pylist():
                    b, cut = _bytes(r["text"]), _merged(r["__spans"])
                    kept = _kept(b, cut)
                    rows.append((r["doc_id"], len(b), len(b) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
                yield _batch(rows, schema)

    return _with_spans(docs, spans).mapInArrow(tidy(task), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut from all ``documents``."""
    docs = keyed(table(spark, sf_dir, "documents"))
    with Workspace(spark, "op2") as ws:
        return ws.result(digests(docs, repeated_spans(ws, docs)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes of repeated strings of ``PASSAGE`` bytes, n_chars counted anew.

    A character that a cut goes through goes as well; nothing else changes. Null and empty texts stay as they are; rows that repeat
    identifier and text repeat each other, and lose what they share.
    """
    with Workspace(spark, "suffix-stage") as ws:
        spans = ws.result(repeated_spans(ws, keyed(docs), PASSAGE), "spans")
        at, kinds = docs.columns, docs.schema

        def task(batches):
            for batch in batches:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    texts = [t if not s else _kept(_bytes(t), _merged(s)).decode("utf-8", "ignore") for t, s in zip(part.column("text").to_pylist(), part.column("__spans").to_pylist())]
                    new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
                    cols = {c: pa.array(new[c], part.column(c).type) if c in new else part.column(c) for c in at}
                    yield pa.RecordBatch.from_pydict(cols)

        return _with_spans(docs, spans).mapInArrow(tidy(task), kinds)


#: The same rows window by window, over hexadecimal digits as DuckDB's strings count characters.
SQL = f"""
with b as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, i, md5_number(substr(x, 2 * i + 1, 2 * {LENGTH})) as h from (select r, x, unnest(range(0, greatest(length(x) // 2 - {LENGTH} + 1, 0))) as i from b)),
twice as (select r, i from (select r, i, count(*) over (partition by h) as n from w) where n > 1),
marked as (select r, i, case when i > lag(i) over (partition by r order by i) + {LENGTH} then 1 else 0 end as fresh from twice),
spans as (select r, min(i) as a, max(i) + {LENGTH} as z from (select r, i, sum(fresh) over (partition by r order by i rows unbounded preceding) as k from marked) group by r, k),
parts as (
  select r, a as place, substr(x, 2 * before + 1, 2 * (a - before)) as part, z - a as cut from (select *, coalesce(lag(z) over (partition by r order by a), 0) as before from spans) join b using (r)
  union all select r, 1e15, substr(x, 2 * coalesce(last, 0) + 1), 0 from b left join (select r, max(z) as last from spans group by r) using (r)
),
kept as (select r, string_agg(part, '' order by place) as k, sum(cut) as n_removed, count(*) - 1 as n_spans from parts group by r)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, n_spans, sha256(unhex(k)) as kept_sha256 from b join kept using (r)
"""
