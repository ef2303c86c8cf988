"""Best-fit packing planned on the histogram of lengths.

The plan sees counts of lengths, never documents: best-fit decreasing over at most ``capacity`` counts gives ranges of slots, and each
piece takes the slot of its rank among the pieces of its length. What the driver holds depends on ``capacity`` alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, table, tidy
from .tokens import encoder

CAPACITY = 2048
END = 0


class Slots(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank``, ``count`` of them, go to sequences from ``sequence``, ``each`` to one, from ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts: a piece goes where the least room that suffices is left, else into a new sequence.

    Sequences with the same room are kept as ranges of their numbers. Equal lengths fill a sequence as often as they fit before the next
    is taken, as best fit does one by one; so a range stays whole but for the last that a length touches.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out, new = [], 0

    def give(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in room:
                room[r] = []
                insort(rooms, r)
            room[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                r = rooms[i]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[i]
            else:
                r, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            each = r // length
            used = min(left, n * each)
            full, part = divmod(used, each)
            out.append(Slots(length, rank, used, first, each, capacity - r))
            give(r - each * length, first, full)
            give(r - part * length, first + full, int(part > 0))
            give(r, first + full + (part > 0), n - full - (part > 0))
            left, rank = left - used, rank + used
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Whole texts as token pieces: doc_id, piece, start, length, ids_crc32, and ids where asked for.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``; the first is what is left over. A null text is
    empty: its one piece is the end id. Null and repeated identifiers are rows like others; extra columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], ddl + ", ids array<int>"
    schema = pa.schema(fields)

    def task(batches):
        enc = None
        for batch in batches:
            enc = enc or encoder(tokenizer, end_id)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 256):
                rows = []
                for doc, e in zip(ids[i : i + 256], enc.encode(texts.slice(i, 256).to_pylist())):
                    n, at = len(e) // 4, 0
                    for k in range(-(-n // capacity)):
                        to = (n - 1) % capacity + 1 + k * capacity
                        own = e[4 * at : 4 * to]
                        rows.append((doc, k, at, to - at, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else [])))
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(task, False), ddl)


def place(cut: DataFrame, capacity: int = CAPACITY, per_bucket: int = 100_000) -> DataFrame:
    """Pieces (a stored table with ``length``) with ``sequence_id`` and ``offset``.

    A length may hold a third of all pieces, so ranks are counted in hash buckets of a length and moved up by the buckets before.
    Rows that tie in every column are alike, so it doesn't matter which takes which slot.
    """
    spark, total = cut.sparkSession, cut.count()
    ids = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut.columns]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(*ids), F.lit(partitions(spark, total, per_bucket))))
    counts = cut.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # at most one row for each length up to the capacity
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, 6)
    slots = spark.sparkContext.broadcast(slots[np.lexsort((slots[:, 1], slots[:, 0]))])
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*ids)).cast("long") - 1)
    ranked = ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")

    def task(batches):
        s = slots.value
        starts = s[:, 0] << 44 | s[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = s[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            nth = rank - own[:, 1]
            cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            cols |= {"sequence_id": pa.array(own[:, 3] + nth // own[:, 4]), "offset": pa.array(own[:, 5] + nth % own[:, 4] * length)}
            yield pa.RecordBatch.from_pydict(cols)

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(tidy(task), f"{kinds}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """Placed pieces with ids as sequences: sequence_id, ids. A group has no more pieces than ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def pack(ws: Workspace, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Pieces of ``docs`` with their places; an empty table gives an empty one."""
    return place(ws.save(pieces(docs, tokenizer, capacity, **columns), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of ``CAPACITY`` ids."""
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places; null texts are one end id, null and repeated identifiers are rows like others."""
    import public_tokenizers

    with Workspace(spark, "op6") as ws:
        out = pack(ws, docs, public_tokenizers.path("byte_bpe_50k.json"))
        return ws.result(out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
