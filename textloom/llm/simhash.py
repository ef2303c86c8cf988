"""SimHash fingerprints, and near duplicates by anchor-point covering.

A covering code of radius R puts every value within R bits of an anchor. If two values differ in at most t bits, the anchor nearest to
the one lies within R + t of the other. So each value asks at its nearest anchor and is listed at every anchor within R + t, and every
pair within t meets at an anchor.

A fingerprint has 64 bits, three blocks. The code is the binary Golay code: perfect, 23 bits, 4096 anchors, R = 3; blocks are shorter, and
padded with zeros. Of four differing bits the block with most of them has two at least, so the two others have one each at most, or
one has none and the other two. An anchor is one of two blocks together, so there are 3 * 2^24, and a value is listed at about 61 of
each pair of blocks: the rows grow with the values, and a list is 3.6 millionths of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, plain_words, table, tidy
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: First bit and bits of each block, and the pairs of blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # of the Golay code, a fixed value
CODE_RADIUS = 3
#: Values listed at one anchor that one task compares; an anchor with more is dealt over several tasks.
AT_ONCE = 4096
#: Lists up to this length are compared side by side.
SHORT = 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash over word shingles, unsigned; 0 where there are no words."""
    import xxhash

    words = plain_words(text)
    if not words:
        return 0
    buf, n = b" ".join(words), len(words)
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(buf, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(buf[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text. Null and empty texts have fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def task(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(task), "doc_id long, fp long")


@cache
def golay(more: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each remainder the pattern that leads to the nearest anchor; all patterns of up to R + ``more`` bits by remainder, light ones
    first; where each remainder's begin."""
    patterns = [0]
    for _ in range(CODE_RADIUS + more):
        patterns = list({p | 1 << i for p in patterns for i in range(23)} | set(patterns))
    errors = np.array(sorted(patterns), np.int64)
    rem, weight = remainders(errors), np.bitwise_count(errors)
    near = np.zeros(2048, np.int64)
    light = weight <= CODE_RADIUS
    near[rem[light]] = errors[light]
    order = np.lexsort((weight, rem))
    return near, errors[order], np.searchsorted(rem[order], np.arange(2049))


def remainders(x: np.ndarray) -> np.ndarray:
    for i in range(22, 10, -1):
        x = np.where(x >> i & 1, x ^ (GENERATOR << (i - 11)), x)
    return x


@cache
def _upto() -> np.ndarray:
    """How many patterns of each remainder have up to R, R + 1 and R + 2 bits."""
    _, errors, first = golay(2)
    weight = np.bitwise_count(errors)
    return np.stack([np.add.reduceat((weight <= CODE_RADIUS + t).astype(np.int64), first[:-1]) for t in range(3)], axis=1)


def _crossed(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) for i under n and j under m of each row."""
    row = np.repeat(np.arange(len(n)), n * m)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return row, at // m[row], at % m[row]


def anchors(fp: np.ndarray, pair: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, asks) for the anchors of a pair of blocks at which values are listed; a value asks at the nearest one."""
    _, errors, first = golay(2)
    x, rem = [], []
    for at, bits in (BLOCKS[b] for b in PAIRS[pair]):
        x.append((fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        rem.append(remainders(x[-1]))
    (n0, n1, n2), (m0, m1, m2) = _upto()[rem[0]].T, _upto()[rem[1]].T
    # one bit in either block, or two in one of them
    out = []
    for n, skip_n, m, skip_m in ((n1, 0, m1, 0), (n0, 0, m2 - m1, m1), (n2 - n1, n1, m0, 0)):
        row, i, j = _crossed(n, m)
        i, j = i + (skip_n if isinstance(skip_n, int) else skip_n[row]), j + (skip_m if isinstance(skip_m, int) else skip_m[row])
        # the code is systematic in its upper 12 bits, which number the anchors
        a, b = ((x[k][row] ^ errors[first[rem[k][row]] + at]) >> 11 for k, at in enumerate((i, j)))
        out.append((row, (pair << 24) + (a << 12) + b, (i == 0) & (j == 0)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _listed(fps: DataFrame) -> DataFrame:
    """Rows (key, fp, asks) of each value at its anchors."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("asks", pa.bool_())])

    def task(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                fp = batch.column("fp").slice(i, 4096).to_numpy()
                for pair in range(len(PAIRS)):
                    row, anchor, asks = anchors(fp, pair)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(asks)], schema=schema)

    return fps.select("fp").mapInArrow(tidy(task), "key long, fp long, asks boolean")


def _forest(listed: np.ndarray, asks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within the radius of each asker; at most one fewer than values."""
    root, out, step = np.arange(len(listed)), [], max(1, 1_000_000 // max(1, len(listed)))
    for i in range(0, len(asks), step):
        close = np.bitwise_count(asks[i : i + step, None] ^ listed[None, :]) <= radius
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            near = root[close[row]]
            least = near.min()
            old = np.unique(near[near != least])
            if len(old):
                out += [(int(listed[r]), int(listed[least])) for r in old]
                root[np.isin(root, old)] = least
    return out


def links(ws: Workspace, fps: DataFrame, radius: int = RADIUS, at_once: int = AT_ONCE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct values ``fp`` within ``radius`` (up to 4) bits.

    An anchor with more than ``at_once`` values is listed in as many chunks as that needs; each chunk's own askers ask there.
    """
    if radius > RADIUS:
        raise ValueError("the blocks cover four differing bits")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        key, chunk, fp = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("key", "chunk", "fp"))
        asks = np.concatenate([b.column("asks").to_numpy(zero_copy_only=False) for b in parts])
        order = np.lexsort((chunk, key))
        key, chunk, fp, asks = key[order], chunk[order], fp[order].view(np.uint64), asks[order]
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]))))
        size = np.diff(np.append(heads, len(key)))
        # askers of short lists meet all of their list at once
        of = np.repeat(np.arange(len(heads)), size)
        who = np.flatnonzero(asks & (size[of] <= SHORT) & (size[of] > 1))
        out = [np.zeros((0, 2), np.uint64)]
        for i in range(0, len(who), 100_000):
            own = who[i : i + 100_000]
            row, at, _ = _crossed(size[of[own]], np.ones(len(own), np.int64))
            a, b = fp[own[row]], fp[heads[of[own[row]]] + at]
            near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
            out.append(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1))
        for g in np.flatnonzero(size > SHORT):
            own = slice(heads[g], heads[g] + size[g])
            if asks[own].any():
                out.append(np.array(_forest(fp[own], fp[own][asks[own]], radius), np.uint64).reshape(-1, 2))
        both = np.unique(np.concatenate(out), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    listed = _listed(fps)
    crowded = ws.save(listed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > at_once), "crowded")
    n = F.lit(1).cast("long")
    if not crowded.isEmpty():
        listed = listed.join(crowded, "key", "left")
        n = F.ceil(F.coalesce("n", F.lit(1)) / at_once)
    rows = listed.withColumn("m", n).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    rows = rows.select("key", "chunk", "fp", (F.col("asks") & (F.pmod("fp", "m") == F.col("chunk"))).alias("asks"))
    values = fps.count()
    dealt = rows.repartition(partitions(fps.sparkSession, 184 * values, 1_000_000), "key", "chunk")
    return ws.save(dealt.mapInArrow(tidy(task), "a long, b long").distinct(), "links")


def near_duplicates(ws: Workspace, docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of at most ``radius`` bits reach.

    Equal fingerprints meet once, as one value with its smallest identifier. Null and empty texts share fingerprint zero. Rows that
    repeat an identifier each come back; a null identifier never is a component's smallest unless all are null. Extra columns are
    ignored, an empty table gives an empty one.
    """
    own = ws.save(fingerprints(docs, id_col, text_col), "fingerprints")
    values = ws.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(ws, links(ws, values, radius, at_once))
    values = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    values = ws.save(values, "rooted")
    least = values.groupBy("root").agg(F.min("least").alias("component_id"))
    named = values.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all ``documents``."""
    with Workspace(spark, "op4") as ws:
        out = near_duplicates(ws, table(spark, sf_dir, "documents"))
        return ws.result(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
