"""Which texts hold which quotes, as plain strings: every pair, wherever a quote begins or ends in a text.

Up to ``MOST`` quotes make an Aho-Corasick automaton that is sent to every task. A longer list meets the texts by a join on strings of eight
bytes: a quote of ``LONG`` bytes has the one of least hash among its own, which is the least of some ``WINDOW`` neighbours in every text that
holds it, so a text sends the least of each ``WINDOW`` neighbours alone. Shorter quotes meet all strings of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import CHARACTERS, MOST

#: Bytes of the strings that meet, how many neighbours a text's least is taken of, and bytes from which a quote has as many.
GRAM, WINDOW = 8, 24
LONG = GRAM + WINDOW - 1


def hashes(text: bytes, gram: int) -> np.ndarray:
    """A number for each string of ``gram`` bytes, 8 at most, in order; equal strings have equal ones."""
    if len(text) < gram:
        return np.zeros(0, np.uint64)
    held = np.zeros((len(text) - gram + 1, GRAM), np.uint8)
    held[:, :gram] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), gram)
    x = held.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _class(quote: bytes) -> tuple[int, int]:
    return (GRAM, WINDOW) if len(quote) >= LONG else (min(len(quote), GRAM), 1)


def key(quote: bytes) -> tuple[int, int, int]:
    """Where a quote meets texts: bytes of the string, neighbours, and the least hash of its strings."""
    gram, window = _class(quote)
    return gram, window, int(hashes(quote, gram).min().view(np.int64))


def keys(text: bytes, gram: int, window: int) -> np.ndarray:
    """What a text sends to meet quotes of such a key, each once."""
    x = hashes(text, gram)
    if len(x) < window:
        return np.zeros(0, np.int64)
    for step in (1, 2, 4, 8, 8) if window == WINDOW else ():  # 2, 4, 8, 16 and 24 neighbours
        x = np.minimum(x[step:], x[:-step])
    return np.unique(x).view(np.int64)


def holding(docs: DataFrame, doc_id: str, text: str, quotes: DataFrame, quote_id: str, quote: str, most: int = MOST) -> DataFrame:
    """(quote_id, doc_id) of every quote that is part of a text, each pair once. Null texts hold none; null and empty quotes are in none."""
    spark = docs.sparkSession
    asked = quotes.select(F.col(quote_id).alias("_q"), F.col(quote).alias("_quote")).where("_quote <> ''")
    own = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where("_t <> ''")
    few = asked.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.length("_quote").cast("long")).alias("chars")).first()
    met = _joined(own, asked) if few["n"] > most or (few["chars"] or 0) > CHARACTERS else _walked(spark, own, asked)
    return met.select(F.col("_q").alias(quote_id), F.col("_d").alias(doc_id)).distinct()


def _walked(spark, own: DataFrame, asked: DataFrame) -> DataFrame:
    from .names import _automaton

    listed = sorted({r["_quote"] for r in asked.select("_quote").distinct().collect()})
    sent = spark.sparkContext.broadcast(_automaton(listed) if listed else None)

    def task(batches):
        walk = sent.value
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column("_t").to_pylist()):
                own = {name for _, name in walk.iter(t)} if walk is not None else ()
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column("_d").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["_d", "_quote"])

    # as many rows as there are quotes at most
    return own.mapInArrow(task, f"_d {dict(own.dtypes)['_d']}, _quote string").join(F.broadcast(asked), "_quote").select("_q", "_d")


def _joined(own: DataFrame, asked: DataFrame) -> DataFrame:
    keyed = F.udf(lambda q: key(q.encode()), "struct<gram:int,window:int,hash:long>")
    asked = asked.withColumn("_k", keyed("_quote"))
    kinds = [(r["gram"], r["window"]) for r in asked.select("_k.gram", "_k.window").distinct().collect()]  # nine at most
    listed = F.udf(lambda t: [(g, w, int(h)) for b in [t.encode()] for g, w in kinds for h in keys(b, g, w)], "array<struct<gram:int,window:int,hash:long>>")
    own = own.withColumn("_row", F.xxhash64("_d", "_t"))
    met = own.select("_row", F.explode(listed("_t")).alias("_k")).join(asked.select("_k", "_q", "_quote"), "_k").select("_row", "_q", "_quote")
    return met.join(own, "_row").where(F.contains("_t", "_quote")).select("_q", "_d")
