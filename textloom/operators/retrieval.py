"""Vector and fused retrieval: scored (query, document) rows in, ranked rows out. Lexical search is in ``index``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import small

RRF = 60


def ranked(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query with their rank; equal scores go by identifier."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def overlap(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Different tokens that a query and a passage share, 1 at least for what shares any: for passages that are made on the way and have no index."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return own.join(small(asked), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, base: DataFrame, k: int, least: float | None = None, id_col: str = "vec_id", vec: str = "embedding", own: bool = False, most: int = 100_000) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows of each query by cosine, or all of ``least`` or more where k is 0.

    The queries are a stated set of at most ``most`` vectors, sent to every task once; each task keeps its k best of each query, and
    those meet. Scores have six digits, equal ones go by identifier. Null vectors match nothing; ``own`` keeps a row itself.
    """
    rows = queries.where(F.col(vec).isNotNull()).select(id_col, vec).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"over {most} queries; ask in blocks")
    ids = rows[id_col].to_numpy(np.int64)
    q = np.array(rows[vec].tolist(), dtype=np.float64).reshape(len(ids), -1)
    sent = base.sparkSession.sparkContext.broadcast((ids, q))

    def task(batches):
        ids, q = sent.value
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            b = np.array(batch[vec].tolist(), dtype=np.float64)
            bid = batch[id_col].to_numpy(np.int64)
            out = []
            for i in range(0, len(ids), 512):
                s = np.round(q[i : i + 512] @ b.T, 6)
                for row, qid in zip(s, ids[i : i + 512]):
                    ok = np.ones(len(row), bool) if own else bid != qid
                    if least is not None:
                        ok &= row >= least
                    at = np.flatnonzero(ok)
                    if k:
                        at = at[np.lexsort((bid[at], -row[at]))[:k]]
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": bid[at], "score": row[at]}))
            yield pd.concat(out)

    found = base.where(F.col(vec).isNotNull()).select(id_col, vec).mapInPandas(task, "query_id long, vec_id long, score double")
    return ranked(found, k, item="vec_id") if k else found


def fuse(*lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (60 + rank). A list that lacks a document adds nothing."""
    rows = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 8).alias("score"))


def boost(scored: DataFrame, *rules: tuple[Column, float]) -> DataFrame:
    """Scores times the factor of each rule that holds; a null condition does not."""
    score = F.col("score")
    for cond, factor in rules:
        score = score * F.when(cond, factor).otherwise(1.0)
    return scored.withColumn("score", F.round(score, 8))


def best_part(scored: DataFrame, part: str = "chunk", pos: str = "pos") -> DataFrame:
    """A document's score is that of its best part; the first of equal parts stands for it."""
    best = F.max_by(F.struct(part, "score"), F.struct(F.col("score"), -F.col(pos)))
    return scored.groupBy("query_id", "doc_id").agg(best.alias("b")).select("query_id", "doc_id", F.col(f"b.{part}").alias(part), F.col("b.score").alias("score"))


def rerank(hits: DataFrame, score: Column, pool: int = 20, k: int = 5) -> DataFrame:
    """The first ``pool`` hits of each query in the order of another score, the k best of them."""
    return ranked(hits.where(F.col("rank") <= pool).drop("rank").withColumn("score", F.round(score, 6)), k)


def relative(hits: DataFrame) -> DataFrame:
    """Scores relative to the best of the query."""
    w = Window.partitionBy("query_id")
    return hits.withColumn("relative", F.round(F.col("score") / F.when(F.max("score").over(w) > 0, F.max("score").over(w)), 4))


def recall_mrr(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at k and mean reciprocal rank over the queries that have a relevant document; a miss counts zero."""
    first = relevant.select("query_id", "doc_id").distinct().join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    first = first.groupBy("query_id").agg(F.min("rank").alias("first"))
    at = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 4).alias(f"recall_{k}") for k in ks]
    return first.agg(F.count("*").alias("queries"), *at, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def mine_negatives(hits: DataFrame, relevant: DataFrame, most: int = 2, pool: int = 8) -> DataFrame:
    """Hard negatives: the best of the first hits that are not relevant."""
    rest = hits.where(F.col("rank") <= pool).join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    return ranked(rest.drop("rank"), most)
