"""Embedding whitening by a compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

Entries become integers, x = floor(64 c) + 1,000,000, whose large offset would swallow the digits of a plain covariance. Every different x
is one row of the fit list. Sums are exact integers; a centred entry x - S/n is a pair of doubles, a high and a low part; products of
centred entries and their sums go through error-free transformations (Knuth's sum, Veltkamp's split, Dekker's product), so that a task's
outer products add up to about 100 bits. Tasks' high and low parts merge the same way, in two levels. The driver gets one D x D matrix: its
size depends on the vectors' length, not on their number. LAPACK's ``syevd`` (numpy's ``eigh``: reduction to a tridiagonal matrix, then divide and
conquer) solves it, and two steps of refinement against the extended matrix bring eigenvectors to double precision.

Rows whose vector is null, or holds null or non-finite entries, are left out, and so are vectors of another length than most different
vectors have (of equal numbers the longer). 64 c counts as 2^52 at most, to either side. Repeated vectors count once in the fit list and get a
row each; null identifiers stay. A component whose eigenvalue is zero to double precision can't be whitened and is not returned: a
table without rows, or with one different vector, gives none. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table, tidy

SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**52
COMPONENTS = 16
#: Rows whose outer products are summed before they join the task's sum.
BLOCK = 256
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# error-free transformations


def two_sum(a, b):
    """a + b and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    """Halves of 26 bits, whose products are exact."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def added(x, y):
    """Sum of two numbers of a high and a low part each."""
    s, e = two_sum(x[0], y[0])
    return two_sum(s, e + (x[1] + y[1]))


def outer(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over rows of the outer products of rows with themselves: the upper triangle, row by row, in high and low parts."""
    big, small = split(high)
    parts = []
    for i in range(high.shape[1]):
        a, b, (ah, al), (bh, bl) = high[:, i : i + 1], high[:, i:], (big[:, i : i + 1], small[:, i : i + 1]), (big[:, i:], small[:, i:])
        p = a * b
        e = ((ah * bh - p) + ah * bl + al * bh) + al * bl
        e += a * low[:, i:]
        e += low[:, i : i + 1] * b
        while len(p) > 1:  # halves against each other
            k = len(p) // 2
            s, t = two_sum(p[:k], p[k : 2 * k])
            t += e[:k]
            t += e[k : 2 * k]
            if len(p) % 2:
                s[0], u = two_sum(s[0], p[-1])
                t[0] += u + e[-1]
            p, e = s, t
        parts.append(two_sum(p[0], e[0]))
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


# vectors as integers


def encoded(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x: the integers of each valid vector, eight bytes each."""

    def task(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(size)
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - size])
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(np.clip(flat[np.repeat(good, size)] * SCALE, -MOST, MOST)).astype("<i8") + OFFSET
            places = np.concatenate([[0], np.cumsum(8 * size[good])]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(places), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), packed], ["vec_id", "x"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(tidy(task), "vec_id long, x binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


@dataclass(frozen=True)
class Centre:
    """The number of different vectors and their exact sums."""

    n: int
    sums: tuple[int, ...]

    def parts(self):
        """Whole part of the means, and their fractions as high and low parts."""
        rest = [Fraction(s % self.n, self.n) for s in self.sums]
        high = np.array([float(f) for f in rest])
        return np.array([s // self.n for s in self.sums], np.int64), high, np.array([float(f - Fraction(h)) for f, h in zip(rest, high.tolist())])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, high, low = self.parts()
        h, rest = two_sum((x - whole).astype(np.float64), -high)
        return two_sum(h, rest - low)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        whole, rest = self.parts()[0], np.array([s % self.n for s in self.sums], object)
        q = x - whole
        top = (int(np.abs(q).max(initial=0)) + 1) * self.n
        if x.shape[1] * top * top < 2**63:
            z = q * self.n - rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = q.astype(object) * self.n - rest
        return [v if v < 2**63 else None for v in (z * z).sum(axis=1).tolist()]


# sums over tasks


def _whole(df: DataFrame, task, merge) -> tuple | None:
    """One (high, low) for the whole of ``df``: ``task`` makes one of each task's batches, and ``merge`` puts two together.

    Tasks' rows meet in about as many groups as the square root of their number, and the driver merges the groups' rows.
    """
    pack = lambda x: pa.RecordBatch.from_pydict({k: pa.array([np.ascontiguousarray(v, "<f8").tobytes()], pa.binary()) for k, v in zip(("high", "low"), x)})
    unpack = lambda row: tuple(np.frombuffer(bytes(x), "<f8") for x in row)

    def first(batches):
        out = task(batches)
        if out is not None:
            yield pack(out)

    def second(batches):
        out = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = unpack(row) if out is None else merge(out, unpack(row))
        if out is not None:
            yield pack(out)

    ddl = "high binary, low binary"
    groups = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    out = None
    for row in df.mapInArrow(tidy(first), ddl).repartition(groups).mapInArrow(tidy(second), ddl).toLocalIterator():
        out = unpack(row) if out is None else merge(out, unpack(row))
    return out


def centre(fit: DataFrame, dims: int) -> Centre:
    """Of the stored fit list (x): one row for each dimension comes to the driver."""

    def task(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & (2**26 - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["d", "n", "high", "low"])

    rows = fit.select("x").mapInArrow(tidy(task), "d long, n long, high long, low long").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    rows.sort(key=lambda r: r["d"])
    return Centre(rows[0]["n"] if rows else 0, tuple((r["high"] << 26) + r["low"] for r in rows))


def covariance(fit: DataFrame, at: Centre) -> np.ndarray:
    """Of the stored fit list, in extended precision: centred before multiplying, divisor n."""
    dims = len(at.sums)

    def task(batches):
        out = None
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for i in range(0, len(x), BLOCK):
                own = outer(*at.centred(x[i : i + BLOCK]))
                out = own if out is None else added(out, own)
        return out

    high, low = _whole(fit.select("x"), task, added)
    cov, upper = np.zeros((dims, dims), np.longdouble), np.triu_indices(dims)
    cov[upper] = (high.astype(np.longdouble) + low) / at.n
    return np.triu(cov) + np.triu(cov, 1).T


def eigen(cov: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down, and unit eigenvectors as columns; the largest entry of each is positive.

    ``eigh`` works in doubles. A step of refinement (Ogita and Aishima) measures in extended precision how far the vectors are from
    orthonormal and the matrix from diagonal, and corrects both to first order; vectors of one eigenvalue are made orthonormal only.
    """
    a, n = cov.astype(np.longdouble), len(cov)
    vectors = np.linalg.eigh(a.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(steps):
        r = np.eye(n, dtype=np.longdouble) - vectors.T @ vectors
        s = vectors.T @ (a @ vectors)
        values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
        vectors = vectors + vectors @ np.where(near, r / 2, (s + r * values[None, :]) / np.where(near, 1, apart))
    for _ in range(2):  # what is left of overlaps, mostly between vectors of eigenvalues near zero
        vectors = vectors + vectors @ (np.eye(n, dtype=np.longdouble) - vectors.T @ vectors) / 2
    values = np.diag(vectors.T @ (a @ vectors))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] < 0, -1, 1)
    return values, vectors * signs


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into whitened components."""

    at: Centre
    #: Columns are eigenvectors over the root of their eigenvalue.
    weights: np.ndarray
    explained: tuple[float, ...]
    values: tuple[float, ...]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.at.centred(x)[0] @ self.weights


def learn(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Of the stored fit list: up to ``components`` components whose eigenvalue is above zero to double precision."""
    at = centre(fit, dims)
    if at.n < 2:
        return Whitening(at, np.zeros((dims, 0)), (), ())
    cov = covariance(fit, at)
    values, vectors = eigen(cov)
    k = min(components, int((values > dims * 2.0**-52 * max(values[0], 0)).sum()))
    trace = np.trace(cov)
    return Whitening(at, (vectors[:, :k] / np.sqrt(values[:k])).astype(np.float64), tuple(float(v / trace) for v in values[:k]), tuple(map(float, values[:k])))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity."""
    sent, dims, k = fit.sparkSession.sparkContext.broadcast(model), len(model.at.sums), len(model.explained)

    def task(batches):
        squares, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = sent.value.apply(matrix(batch.column(0), dims))
            squares, sums = squares + y.T @ y, sums + y.sum(axis=0)
        return squares.ravel(), sums

    squares, sums = _whole(fit.select("x"), task, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    mean = sums / model.at.n  # zero but for rounding, as the vectors are centred
    return float(np.abs(squares.reshape(k, k) / model.at.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(ws: Workspace, rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each valid vector and component: ``OUT``."""
    spark = rows.sparkSession
    own = encoded(rows, id_col, vec_col)
    listed = ws.save(own.select("x").distinct(), "fit")
    sizes = listed.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not sizes or not sizes["size"]:
        return spark.createDataFrame([], OUT)
    dims = sizes["size"] // 8
    valid = F.octet_length("x") == 8 * dims
    fit = listed.where(valid)
    model = learn(fit, dims, components)
    if not model.explained:
        return spark.createDataFrame([], OUT)
    error, sent = identity_error(fit, model), spark.sparkContext.broadcast(model)

    def task(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            y = sent.value.apply(x)
            places = np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.at.deviations(x), pa.int64()), pa.ListArray.from_arrays(pa.array(places), pa.array(y.ravel()))], ["vec_id", "deviation", "y"])

    out = own.where(valid).mapInArrow(tidy(task), "vec_id long, deviation long, y array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("y").alias("pos", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("pos") + 1)
    return out.select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.at.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``, up to sixteen components each."""
    with Workspace(spark, "op12") as ws:
        return ws.result(whiten(ws, table(spark, sf_dir, "embeddings")))
