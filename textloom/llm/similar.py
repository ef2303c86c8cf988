"""Near duplicates of whole texts: candidates by anchor-point covering of long SimHash fingerprints, links by exact similarity.

Texts of which 0.8 of all five-word shingles are common differ in 15% of fingerprint bits on the average, which no cover of 64 bits
finds at a bearable cost. So a fingerprint has ``BLOCKS`` blocks of 23 bits, each covered by the binary Golay code: a value asks at
the nearest of 4096 anchors and is listed at those within radius plus one. A pair of that similarity meets in a block with
probability 0.27 from either side, in one of ten with over 0.98.

At an anchor, the least distances up to ``RADIUS`` that hold its values together (a minimum spanning forest) become links, fewer
than values. Any two values within a distance are connected by forest links that are no longer. Each link is then verified by the exact
similarity of the two shingle sets. Where some fail, a group that the forest held together may fall apart although other pairs of it
are similar: such a group's sets meet, in blocks of bounded size, and all pairs of what fell apart are compared there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, plain_words, tidy
from .compact import _ODD, _pieces, joined, mixed
from .components import components
from .simhash import AT_ONCE, golay, remainders

SIMILAR = 0.8
BLOCKS, BITS, WORDS = 10, 23, 4
#: Bits of 230 in which values may differ: a pair with similarity 0.8 differs in 35, give or take 5.4; unrelated ones in 115.
RADIUS = 52
#: Values, and bytes of shingle sets, that are compared in one task.
PER_BLOCK, BLOCK_BYTES = 4096, 1 << 26


def shingle_set(s: np.ndarray, text: str | None) -> np.ndarray:
    """Different shingles of a text, ascending; a text of fewer than five words is one shingle, one without words has none."""
    import xxhash

    if len(s):
        return np.unique(s)
    words = plain_words(text)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1) | 1] if words else [], np.uint64)


def sketch(own: np.ndarray) -> tuple[int, bytes]:
    """A number for the set and its fingerprint; 0 and zeros for the empty set."""
    if not len(own):
        return 0, bytes(8 * WORDS)
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(own), 2048):
        h = np.stack([mixed(own[i : i + 2048] + np.uint64(k), k % len(_ODD)) for k in range(WORDS)], axis=1)
        counts += np.unpackbits(h.view("u1"), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    value = int(mixed(own, 2).sum(dtype=np.uint64))
    return value - (value >> 63 << 64), np.packbits(2 * counts > len(own), bitorder="little").tobytes()


def _sets(batch: pa.RecordBatch):
    """Pieces of a batch with the shingle set of each text."""
    for part in _pieces(batch):
        texts = part.column("text").to_pylist()
        s, begin = joined(texts)
        yield part, [shingle_set(s[a : b - 1], t) for a, b, t in zip(begin.tolist(), [*begin[1:].tolist(), len(s)], texts)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th, v, fp of each row of ``docs`` (doc_id, th, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("v", pa.int64()), ("fp", pa.binary())])

    def task(batches):
        for batch in batches:
            for part, sets in _sets(batch):
                v, fp = zip(*map(sketch, sets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(v, pa.int64()), pa.array(fp, pa.binary())], schema=schema)

    return docs.mapInArrow(tidy(task), "doc_id long, th long, v long, fp binary")


def _block(fp: np.ndarray, block: int) -> np.ndarray:
    at = block * BITS
    low = fp[:, at // 64] >> np.uint64(at % 64)
    if at % 64 + BITS > 64:
        low = low | fp[:, at // 64 + 1] << np.uint64(64 - at % 64)
    return (low & np.uint64((1 << BITS) - 1)).astype(np.int64)


def anchors(fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, nearest) for the anchors within the covering radius plus one of each value's block."""
    near, errors, first = golay()
    x = _block(fp, block)
    rem = remainders(x)
    n = first[rem + 1] - first[rem]
    row = np.repeat(np.arange(len(x)), n)
    anchor = x[row] ^ errors[first[rem[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
    return row, (anchor >> 11) + (block << 12), anchor == (x ^ near[rem])[row]


def _listed(values: DataFrame, chunks: dict[int, int] | None) -> DataFrame:
    """Rows (key, v, fp, asks) of each value at its anchors; a crowded anchor is dealt over chunks of askers, listed in each of them."""
    schema = pa.schema([("key", pa.int64()), ("v", pa.int64()), ("fp", pa.binary()), ("asks", pa.bool_())])

    def task(batches):
        many = np.ones(BLOCKS << 12, np.int64)
        for a, m in (chunks or {}).items():
            many[a] = m
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                v, raw = part.column("v").to_numpy(), part.column("fp")
                fp = np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(-1, WORDS)
                for block in range(BLOCKS):
                    row, anchor, asks = anchors(fp, block)
                    m = many[anchor]
                    again = np.repeat(np.arange(len(row)), m)
                    chunk = np.arange(len(again)) - np.repeat(np.cumsum(m) - m, m)
                    own = (v[row].view(np.uint64) % m.astype(np.uint64)).astype(np.int64)
                    place = row[again]
                    shown = raw.take(pa.array(place)) if chunks is not None else pa.nulls(len(place), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[again] << 24 | chunk), pa.array(v[place]), shown, pa.array(asks[again] & (chunk == own[again]))], schema=schema)

    return values.select("v", "fp").mapInArrow(tidy(task), "key long, v long, fp binary, asks boolean")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows differ (shapes broadcast)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def forest(fp: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Minimum spanning forest of the distances up to ``radius`` between values that ask and all values, as pairs of rows."""
    who, near = np.flatnonzero(asks), np.zeros(len(fp), bool)
    step = max(1, 500_000 // max(1, len(fp)))
    for i in range(0, len(who), step):
        own = who[i : i + step]
        close = _apart(fp[own, None], fp[None]) <= radius
        close[np.arange(len(own)), own] = False
        near |= close.any(axis=0)
        near[own] |= close.any(axis=1)
    rest = np.flatnonzero(near)
    f, ask, best, source, out = fp[rest], asks[rest], np.full(len(rest), 999, np.int16), np.zeros(len(rest), np.int64), []
    n = len(rest)
    while n:
        k = int(best[:n].argmin())
        if best[k] <= radius:
            out.append((int(source[k]), int(rest[k])))
        now, value, asker = rest[k], f[k].copy(), ask[k]
        n -= 1
        for x in (rest, f, ask, best, source):
            x[k] = x[n]
        at = slice(0, n) if asker else np.flatnonzero(ask[:n])
        apart = _apart(f[at], value)
        nearer = apart < best[at]
        if asker:
            best[:n][nearer], source[:n][nearer] = apart[nearer], now
        else:
            best[at[nearer]], source[at[nearer]] = apart[nearer], now
    return out


def candidates(ws: Workspace, values: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Links (a, b) of values ``v`` that meet at an anchor and are neighbours in its forest."""
    spark = values.sparkSession
    # one row an anchor: 40960 at most, whatever the input
    counts = {r["a"]: r["count"] for r in _listed(values, None).groupBy(F.shiftright("key", 24).alias("a")).count().collect()}
    chunks = {a: -(-n // at_once) for a, n in counts.items() if n > at_once}
    rows = sum(n * chunks.get(a, 1) for a, n in counts.items())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        key, v = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("key", "v"))
        asks = np.concatenate([b.column("asks").to_numpy(zero_copy_only=False) for b in parts])
        fp = np.frombuffer(b"".join(x for b in parts for x in b.column("fp").to_pylist()), "<u8").reshape(-1, WORDS)
        del parts
        order = np.argsort(key, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            if b - a > 1 and asks[own].any():
                pairs = np.array(forest(fp[own], asks[own]), np.int64).reshape(-1, 2)
                out.append(np.sort(v[own][pairs], axis=1))
        both = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    dealt = _listed(values, chunks).repartition(partitions(spark, rows, 300_000), "key")
    return ws.save(dealt.mapInArrow(tidy(task), "a long, b long").distinct(), "candidates")


def verified(ws: Workspace, links: DataFrame, values: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose texts are similar by ``SIMILAR`` or more, by their whole shingle sets, and these sets (v, s)."""
    schema = pa.schema([("v", pa.int64()), ("s", pa.binary())])
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bring(batches):
        for batch in batches:
            for part, sets in _sets(batch):
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=linked).filter(pa.array(keep, pa.bool_()))

    needed = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    texts = values.join(needed, "v").select("v", "th").join(docs.select("th", "text").dropDuplicates(["th"]), "th").select("v", "text")
    sets = ws.save(texts.mapInArrow(tidy(bring), "v long, s binary"), "sets")
    x, y = sets.select(F.col("v").alias("a"), F.col("s").alias("x")), sets.select(F.col("v").alias("b"), F.col("s").alias("y"))
    good = links.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long")
    return ws.save(good, "verified"), sets


def joins(sets: list[np.ndarray], root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets that are similar by ``SIMILAR`` or more and join different roots: with what is joined already they connect all that is similar."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    having = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    often = np.bincount(ids)
    first = np.cumsum(often) - often
    names, label = np.unique(root, return_inverse=True)
    out = []
    # two sets of the largest root need no comparison
    for i in np.flatnonzero(label != np.bincount(label).argmax()):
        own = ids[ends[i] - size[i] : ends[i]]
        n = often[own]
        both = np.bincount(having[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero(both >= SIMILAR * (size[i] + size - both) - 1e-9):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def completed(ws: Workspace, links: DataFrame, good: DataFrame, sets: DataFrame, per_block: int = PER_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(v, root) of all values of ``links``, by ``good`` and the links between different roots of it within a group of ``links``: of these groups all pairs are compared.

    Components are found once over ``good``; after that only its roots are linked, so links inside what is joined already are not followed again.
    A group of two has no pair that was not compared. A group goes to a task as a whole up to ``per_block`` values and ``block_bytes``; of a larger one each two chunks meet.
    """
    named = lambda df, name, node, root: ws.save(components(ws, df), name).select(F.col("node").alias(node), F.col("root").alias(root))
    roots = named(good, "roots", "v", "r")
    between = links
    for end in ("a", "b"):
        between = between.join(roots.select(F.col("v").alias(end), F.col("r").alias(f"r_{end}")), end, "left")
    between = between.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")).where("a <> b").distinct()
    groups = named(ws.save(between, "between"), "groups", "r", "g")
    own = sets.select("v", F.length("s").alias("size")).join(roots, "v", "left").select("v", "size", F.coalesce("r", "v").alias("r"))
    own = ws.save(own.join(groups, "r", "left").select("v", "size", F.coalesce("g", "r").alias("g"), "r"), "grouped")
    apart = own.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high and n > 2")
    half = lambda c, most: F.when(F.col(c) <= most, 1).otherwise(F.ceil(F.col(c) * 2 / most))
    apart = apart.select("g", F.greatest(half("n", per_block), half("size", block_bytes)).cast("long").alias("chunks"))
    dealt = own.join(apart, "g").withColumn("k", F.expr("pmod(v, chunks)")).withColumn("j", F.explode(F.expr("sequence(0L, chunks - 1)")))
    # a chunk meets each other one, and itself where that is all there is
    dealt = dealt.where("chunks = 1 or j <> k").select("g", "v", "r", F.least("j", "k").alias("low"), F.greatest("j", "k").alias("high"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(rows: pa.Table) -> pa.Table:
        r = rows.column("r").to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("s").combine_chunks()]
        both = r[np.array(joins(held, r), np.int64).reshape(-1, 2)]
        return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    more = dealt.join(sets, "v").groupBy("g", "low", "high").applyInArrow(block, "a long, b long")
    last = named(ws.save(more.distinct(), "more"), "last", "r", "root")
    return ws.save(own.join(last, "r", "left").select("v", F.coalesce("root", "r").alias("root")), "completed")


def similar_documents(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = AT_ONCE, per_block: int = PER_BLOCK) -> DataFrame:
    """doc_id, component_id of every row: the smallest doc_id that links of similar texts reach.

    Texts with equal shingle sets are one value. Null and empty texts and those without words are one value; texts of fewer than five
    words are similar to equal ones alone. Rows that repeat an identifier each come back; a null identifier never is a component's
    smallest unless all are null. Extra columns are ignored, an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    own = ws.save(sketches(docs), "sketches")
    values = ws.save(own.groupBy("v").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.min("fp").alias("fp")), "values")
    links = candidates(ws, values, at_once)
    good, sets = verified(ws, links, values, docs)
    roots = completed(ws, links, good, sets, per_block)
    values = ws.save(values.join(roots, "v", "left").select("v", "least", F.coalesce("root", "v").alias("root")), "rooted")
    least = values.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(values.join(least, "root").select("v", "component_id"), "v").select("doc_id", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose component has a smaller identifier. Rows that repeat an identifier stay or go together."""
    with Workspace(spark, "simhash-stage") as ws:
        own = similar_documents(ws, docs)
        gone = own.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("not stays")
        gone = ws.result(gone.select(F.col("doc_id").alias("__gone")), "gone")
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
