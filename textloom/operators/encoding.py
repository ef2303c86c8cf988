"""Text encoders: an interface for any model that turns texts into vectors, and one that is trained here.

``encode`` loads a model once in each Python worker and gives it each different text of a batch once. The trained encoder hashes words, pairs
of words and character n-grams within words, weighs them by 1 + ln(tf) and smoothed idf, and projects rows of unit length on their
first right singular vectors. These come by subspace iteration: a round is one pass in which tasks sum X'(XQ), so the driver holds a few
matrices of columns times dimensions, whatever the number of texts. Texts are cut once; all passes are over their stored entries.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import delete_folder, shared_folder
from .sums import over_tasks

#: Columns that words and pairs are hashed to, as many that character n-grams are hashed to, and dimensions of vectors.
COLUMNS, DIMENSIONS = 1 << 12, 64
GRAMS = (2, 5)
#: Longer words are not remembered. Rows that are multiplied at once, over the columns that they have.
LONG, ROWS = 64, 64


def _hash(told: str, columns: int) -> int:
    return zlib.crc32(told.encode("utf-8", "replace")) % columns


#: CRC-32 by bytes.
_TABLE = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _grams(words: list[str], columns: int) -> np.ndarray:
    """Columns of the character n-grams of ASCII words with a space on either side: all places of the words at once."""
    told = np.frombuffer(f" {'  '.join(words)} ".encode(), np.uint8)
    between, crc, ok, out = (told[1:] == 32) & (told[:-1] == 32), np.uint32(0xFFFFFFFF), True, []
    for n in range(1, GRAMS[1] + 1):
        places = max(len(told) - n + 1, 0)
        crc = crc[:places] if n > 1 else crc
        crc = _TABLE[(crc ^ told[n - 1 :]) & 255] ^ (crc >> 8)
        if n > 1:
            ok = (ok[:places] if n > 2 else ok) & ~between[n - 2 :]
        if n >= GRAMS[0]:
            out.append(columns + (~crc[ok] % columns).astype(np.int64))
    return np.concatenate(out)


def _word(word: str, columns: int) -> np.ndarray:
    """Columns of a word, and of its character n-grams with a space on either side."""
    padded = f" {word} "
    return np.array([_hash(word, columns), *(columns + _hash(padded[i : i + n], columns) for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(padded) - n + 1))])


_known = lru_cache(1 << 16)(_word)


def entries(text: str | None, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending columns of a text and how often it has each: words and pairs in the first half, character n-grams in the second."""
    words = re.findall(r"\w+", (text or "").lower())
    parts = [np.fromiter((_hash(f"{a} {b}", columns) for a, b in zip(words, words[1:])), np.int64)]
    if plain := [w for w in words if w.isascii()]:
        parts += [np.fromiter((_hash(w, columns) for w in plain), np.int64), _grams(plain, columns)]
    parts += [(_known if len(w) <= LONG else _word)(w, columns) for w in words if not w.isascii()]
    found = np.bincount(np.concatenate(parts))
    at = np.flatnonzero(found)
    return at, found[at]


def counts(text: str | None, columns: int = COLUMNS) -> Counter:
    """The same as a counter."""
    at, n = entries(text, columns)
    return Counter(dict(zip(at.tolist(), n.tolist())))


@dataclass(frozen=True)
class Encoder:
    """idf of columns, and the projection of columns to dimensions."""

    idf: np.ndarray
    projection: np.ndarray

    def weighed(self, size: np.ndarray, col: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and weight of each entry of rows of such sizes; rows with any are of unit length."""
        row = np.repeat(np.arange(len(size)), size)
        value = (1 + np.log(n)) * self.idf[col]
        norm = np.sqrt(np.bincount(row, value * value, len(size)))
        return row, col, value / norm[row]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A vector for each text; a text without words gets zeros."""
        out = np.zeros((len(texts), self.projection.shape[1]))
        for i in range(0, len(texts), ROWS):
            told = [entries(t, len(self.idf) // 2) for t in texts[i : i + ROWS]]
            used, x = dense(*self.weighed(np.array([len(at) for at, _ in told]), *(np.concatenate(c) for c in zip(*told))), len(told))
            out[i : i + ROWS] = x @ self.projection[used]
        return out


def dense(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns that some rows have, and the rows over these."""
    used = np.flatnonzero(np.bincount(col))
    place = np.zeros(used[-1] + 1 if len(used) else 0, np.int64)
    place[used] = np.arange(len(used))
    out = np.zeros((n, len(used)))
    out[row, place[col]] = value
    return used, out


@contextmanager
def counted(df: DataFrame, text: str = "text", columns: int = COLUMNS) -> Iterator[DataFrame]:
    """``df`` with the entries of each text, ``at`` and ``n``, in its stead. They are a table of the shared folder while the context lasts: texts are read and cut once."""
    spark, others = df.sparkSession, [c for c in df.columns if c != text]
    folder = shared_folder(spark, "entries")
    rows = df.select(*others, F.col(text).alias("text"))
    kind = StructType([*df.select(*others).schema, StructField("at", ArrayType(IntegerType())), StructField("n", ArrayType(IntegerType()))])

    def task(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                told = [entries(t, columns) for t in part.column(len(others)).to_pylist()]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(at) for at, _ in told])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(np.int32))) for c in zip(*told)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), *lists], [*others, "at", "n"])

    try:
        rows.mapInArrow(task, kind).write.parquet(folder)
        yield spark.read.schema(kind).parquet(folder)
    finally:
        delete_folder(spark, folder)


def _blocks(batches, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches, with the sizes, columns and counts of their rows."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            part = batch.slice(i, rows)
            at, n = part["at"], part["n"]
            yield part, at.value_lengths().to_numpy(zero_copy_only=False), at.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False)


def vectors(made: DataFrame, encoder: Encoder, out: str = "vector") -> DataFrame:
    """``made`` of ``counted`` with the vector of each row instead of its entries: those that the encoder gives for the text."""
    others = [c for c in made.columns if c not in ("at", "n")]
    sent = made.sparkSession.sparkContext.broadcast(encoder)

    def task(batches):
        encoder = sent.value
        for part, size, col, n in _blocks(batches, ROWS):
            used, x = dense(*encoder.weighed(size, col, n), len(part))
            told = x @ encoder.projection[used]
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * told.shape[1])
            yield pa.RecordBatch.from_arrays([*(part[c] for c in others), pa.ListArray.from_arrays(ends, pa.array(told.ravel()))], [*others, out])

    return made.mapInArrow(task, StructType([*made.select(*others).schema, StructField(out, ArrayType(DoubleType()))]))


def fit(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, columns: int = COLUMNS, rounds: int = 6, spare: int = 8) -> Encoder:
    """An encoder of all rows. Null and empty texts count as rows without words. More ``rounds`` come closer to the singular vectors.

    Directions have the sign that makes their largest entry positive; those without any variance are zeros.
    """
    with counted(texts.select(text), text, columns) as made:
        return fit_counted(made, dimensions, columns, rounds, spare)


def fit_counted(made: DataFrame, dimensions: int = DIMENSIONS, columns: int = COLUMNS, rounds: int = 6, spare: int = 8) -> Encoder:
    """The same of the rows of ``counted``, whose texts are not read again."""
    rows, size = made.select("at", "n"), 2 * columns

    def frequencies(batches):
        out = np.zeros(1 + size)
        for part, _, col, _ in _blocks(batches, 1024):
            out[0] += len(part)
            out[1:] += np.bincount(col, minlength=size)
        return out

    df = over_tasks(rows, frequencies)
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    k = min(dimensions + spare, size)
    base = np.linalg.qr(np.random.default_rng(7).normal(size=(size, k)))[0]
    bare = Encoder(idf, base)

    def multiplied(right: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast(right)

        def task(batches):
            out, right = np.zeros((size, k)), sent.value
            for part, sizes, col, n in _blocks(batches, ROWS):
                used, x = dense(*bare.weighed(sizes, col, n), len(part))
                out[used] += x.T @ (x @ right[used])
            return out.ravel()

        total = over_tasks(rows, task).reshape(size, k)
        sent.destroy()
        return total

    for _ in range(rounds):
        base = np.linalg.qr(multiplied(base))[0]
    values, turn = np.linalg.eigh(base.T @ multiplied(base))
    order = np.argsort(-values)[:dimensions]
    vectors = base @ turn[:, order] * (values[order] > 1e-12 * max(values.max(), 1e-300))
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Encoder(idf, vectors * signs)


def encode(load: Callable[[], Callable[[list], np.ndarray]], batch: int = 256) -> Callable[[Column], Column]:
    """A function of a text column for any encoder. ``load`` gives the model and is called once in a worker; the model takes a list of texts.

    Of equal texts of a batch one goes to the model. Null and blank texts are zeros: the model is not asked.
    """

    def make():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            told = ["" if t is None else str(t) for t in texts]
            different = sorted({t for t in told if t.strip()})
            vectors = model(different or [" "])
            place = {t: i for i, t in enumerate(different)}
            out = np.zeros((len(told), vectors.shape[1]))
            for i, t in enumerate(told):
                if t in place:
                    out[i] = vectors[place[t]]
            return out

        return predict

    run = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)
    return lambda text: run(F.coalesce(text, F.lit("")))
