"""Joins over multi-valued keys, intervals and lookups, with misses that are reported rather than lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ordered_values, small


class MissingKeys(ValueError):
    """Rows refer to keys that the other side doesn't have."""


def strict(left: DataFrame, right: DataFrame, on: str, name: str = "lookup") -> DataFrame:
    """Inner join to a dimension of unique keys in which a miss is an error. The check reads keys alone."""
    lost = left.select(on).join(right.select(on), on, "left_anti").limit(3).collect()
    if lost:
        raise MissingKeys(f"{name}: {[r[0] for r in lost]}")
    return left.join(small(right), on)


def multi_lookup(df: DataFrame, ids: Column, dim: DataFrame, key: str, value: str, row: str, out: str) -> DataFrame:
    """(row, out): for a column of several keys the values of a dimension, in the order of the keys; unknown keys are left out."""
    parts = df.select(F.col(row), F.posexplode(ids).alias("_pos", key))
    return parts.join(small(dim.select(key, value)), key).groupBy(row).agg(ordered_values(F.col("_pos"), F.col(value)).alias(out))


def unknown_keys(df: DataFrame, ids: Column, dim: DataFrame, key: str, row: str) -> DataFrame:
    """Rows and keys that the dimension doesn't have."""
    return df.select(F.col(row), F.explode(ids).alias(key)).join(dim.select(key), key, "left_anti")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], start: str = "start", end: str = "end", kind: str = "inner") -> DataFrame:
    """Half-open intervals that overlap within equal keys. The keys make the join a hash join; the intervals remain as a condition."""
    a, b = a.alias("a"), b.alias("b")
    cond = (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}"))
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, cond, kind)


def first_seen_mode(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Most frequent value of each group; of equal ones the one that came first."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_at"))
    best = F.max_by(value, F.struct(F.col("_n"), -F.col("_at")))
    return counts.groupBy(*by).agg(best.alias(value))


def ordered_distinct(df: DataFrame, by: list[str], value: str, pos: str, out: str) -> DataFrame:
    """Different values of each group in the order in which they came; a value counts once before any group is gathered."""
    seen = df.groupBy(*by, value).agg(F.min(pos).alias("_at"))
    return seen.groupBy(*by).agg(ordered_values(F.col("_at"), F.col(value)).alias(out))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; unlike dropDuplicates the same one every time. One partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_r.*").select(*df.columns)


def either(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer join of two lists that prefers the first one's value."""
    return a.join(b.withColumnRenamed(value, "_other"), on, "full").withColumn(value, F.coalesce(value, "_other")).drop("_other")


def blend(tables: list[tuple[DataFrame, float]], key: str = "row_id", label: str = "label", p: str = "p") -> DataFrame:
    """Weighted mean of probability tables in long form; a label that a table lacks has probability zero there."""
    whole = sum(w for _, w in tables)
    rows = None
    for df, w in tables:
        part = df.select(key, label, (F.col(p) * w).alias(p))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key, label).agg(F.round(F.sum(p) / whole, 6).alias(p))


def roll_up(probs: DataFrame, parents: DataFrame, fallback: str = "out_of_scope", key: str = "row_id") -> DataFrame:
    """Probabilities of labels added up by the labels' parents; a label without one falls to ``fallback``."""
    return probs.join(small(parents), "label", "left").groupBy(key, F.coalesce("parent", F.lit(fallback)).alias("parent")).agg(F.round(F.sum("p"), 6).alias("p"))


def first_slot(slots: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return slots.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Terms of a set of queries that goes to every task; a larger one is joined.
MOST = 200_000
#: Pairs of a query's term and a row that a task looks at together.
TOGETHER = 1 << 20


def best_containment(asked: DataFrame, rows: DataFrame, query: str, terms: str, row: str, words: str, most: int | None = None) -> DataFrame:
    """(query, row, score): the row with the greatest share of each query's terms, in six digits; of equal ones the least. Both lists have no term twice.

    A stated set of queries goes to every task, which keeps its best row of each: pairs of queries and rows are never grouped.
    """
    listed = asked.select(query, F.size(terms).alias("size"), F.explode(terms).alias("term"))
    known = listed.limit((MOST if most is None else most) + 1).collect()
    first = lambda score: F.max(F.struct(score, -F.col(row))).alias("b")
    if len(known) > (MOST if most is None else most):
        share = rows.select(row, F.explode(words).alias("term")).join(listed, "term").groupBy(query, row, "size").agg(F.count("*").alias("n"))
        best = share.groupBy(query).agg(first(F.round(F.col("n") / F.col("size"), 6).alias("score")))
        return best.select(query, (-F.col("b.col2")).alias(row), F.col("b.score").alias("score"))
    ids = sorted({(r[query], r["size"]) for r in known}, key=lambda x: (x[0] is not None, x))
    place = {x: k for k, x in enumerate(ids)}
    listed = sorted((r["term"], place[r[query], r["size"]]) for r in known)
    vocabulary = sorted({t for t, _ in listed})
    number = {t: k for k, t in enumerate(vocabulary)}
    owner = np.array([q for _, q in listed], np.int64)
    at = np.searchsorted(np.array([number[t] for t, _ in listed], np.int64), np.arange(len(vocabulary) + 1))
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary, owner, at, np.array([n for _, n in ids], np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, owner, at, size = sent.value
        values = pa.array(vocabulary, pa.string())
        for batch in batches:
            lists = batch.column(1)
            per = lists.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), np.nan_to_num(per).astype(np.int64))
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
            doc, code = doc[code >= 0], code[code >= 0]
            count = at[code + 1] - at[code]
            upto, a, own = np.concatenate([[0], np.cumsum(count)]), 0, batch.column(0)
            ends = np.flatnonzero(np.diff(doc, append=-1)) + 1  # a row's terms stay together
            while a < len(doc):
                b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(upto[ends], upto[a] + TOGETHER, "right") - 1)])
                c = count[a:b]
                places = np.arange(upto[b] - upto[a]) + np.repeat(at[code[a:b]] - (upto[a:b] - upto[a]), c)
                key, n = np.unique(owner[places] * len(batch) + np.repeat(doc[a:b], c), return_counts=True)
                q, r = key // len(batch), key % len(batch)
                digits = (2_000_000 * n + size[q]) // (2 * size[q])  # the score as Spark rounds it, in millionths
                value = np.array(pc.fill_null(own, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False))[r]
                order = np.lexsort((value, -digits, q))
                order = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
                yield pa.RecordBatch.from_arrays([pa.array(q[order]), own.take(pa.array(r[order])), pa.array(n[order].astype(np.int64)), pa.array(size[q[order]])], ["_q", row, "n", "size"])
                a = b

    found = rows.select(F.col(row).cast("long"), words).mapInArrow(task, f"_q long, {row} long, n long, size long")
    best = found.groupBy("_q").agg(first(F.round(F.col("n") / F.col("size"), 6).alias("score")))
    names = rows.sparkSession.createDataFrame([(k, x) for k, (x, _) in enumerate(ids)], f"_q long, {query} {dict(asked.dtypes)[query]}")
    return best.join(F.broadcast(names), "_q").select(query, (-F.col("b.col2")).alias(row), F.col("b.score").alias("score"))
