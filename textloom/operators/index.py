"""A stored inverted index: postings by shard and term in blocks, each with its greatest contribution, searched best block first.

Documents are dealt to shards by a hash of their identifier and numbered within a shard in the order of identifiers; a block is a range
of such numbers. A term's row in a shard holds the term's documents, what each adds to a score, and for every block the greatest of that. A
query's bound for a block is the sum of its terms' greatest contributions; blocks are scored from the highest bound down, until k documents are
known that no other block can beat. So a shard gives at most k rows a query, whatever the number of documents with a term of it.

The index is a bucketed table, one bucket a shard: a search groups by shard without moving postings, and what is shuffled is k rows a
query and shard. Texts are read once, when the index is built; it stays in the shared folder until ``drop``.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import shared_root

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Documents of a shard, about, and of a block: building a shard of documents with 230 different words each takes some 350 MB of a task.
SHARD, BLOCK = 8192, 512
#: Different terms of a stated set of queries.
MOST = 100_000
#: Scores have six digits: a block goes on until its bound is below the k-th score by more than rounding.
SLACK = 2e-6

_ROW = "shard int, term string, blocks array<int>, tops array<double>, begins array<int>, docs array<int>, gains array<double>, ids array<bigint>"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, len, terms, tfs of each row: different terms with their counts. Null and empty texts have none."""

    def task(batches):
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            n = max(len(words.dictionary), 1)
            key, tf = np.unique(np.repeat(np.arange(len(batch), dtype=np.int64), size) * n + words.indices.to_numpy(), return_counts=True)
            per = np.bincount(key // n, minlength=len(batch))
            terms = words.dictionary.take(pa.array(key % n))
            ends = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf))], ["doc_id", "len", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tokens(F.col(text)).alias("toks"))
    return rows.mapInArrow(task, "doc_id long, len long, terms array<string>, tfs array<bigint>")


def _sharded(avgdl: float, block: int):
    """A function of a shard's documents: its postings, and a row without a term for the identifiers."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        group = group.take(pc.sort_indices(group, [("doc_id", "ascending"), ("len", "ascending")], null_placement="at_start")).combine_chunks()
        ids, size = group["doc_id"].combine_chunks(), group["len"].to_numpy()
        terms, tfs = group["terms"].combine_chunks(), group["tfs"].combine_chunks()
        per = terms.value_lengths().to_numpy(zero_copy_only=False)
        words, tf = terms.flatten().dictionary_encode(), tfs.flatten().to_numpy()
        doc, code = np.repeat(np.arange(len(ids), dtype=np.int32), per), words.indices.to_numpy()
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / avgdl))
        order = np.argsort(code, kind="stable")  # documents stay in order
        doc, code, gain = doc[order], code[order], gain[order]
        # where a term's block begins
        key_of = code.astype(np.int64) * (len(ids) // block + 1) + doc // block
        at = np.flatnonzero(np.concatenate([[True], key_of[1:] != key_of[:-1]])) if len(key_of) else np.zeros(0, np.int64)
        n = len(words.dictionary)
        df, blocks = np.bincount(code, minlength=n), np.bincount(code[at], minlength=n)
        first = np.concatenate([[0], np.cumsum(df)])[:-1]
        tops = np.maximum.reduceat(gain, at) if len(at) else np.zeros(0)
        begins = (at - first[code[at]]).astype(np.int32)
        none = lambda kind: pa.array([[]], pa.list_(kind))
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
        cols = [_lists((doc[at] // block).astype(np.int32), blocks), _lists(tops, blocks), _lists(begins, blocks), _lists(doc, df), _lists(gain, df)]
        cols = [pa.concat_arrays([c.cast(pa.list_(k)), none(k)]) for c, k in zip(cols, kinds)]
        owners = pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)])
        names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""])])
        return pa.table([pa.array(np.full(n + 1, shard, np.int32)), names, *cols, owners], names=["shard", "term", "blocks", "tops", "begins", "docs", "gains", "ids"])

    return build


def best(terms: list[tuple[float, int]], rows: dict, ids: np.ndarray, k: int, block: int, plain: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, documents) of the k best of a shard, and how many blocks were scored. ``terms``: weights and rows; ``plain``: a term adds its weight alone."""
    n = len(ids) // block + 1
    bound, has = np.zeros(n), np.zeros(n, bool)
    parts = []
    for w, j in terms:
        blocks, tops, begins, docs, gains = rows[j]
        place = np.full(n, -1, np.int32)
        place[blocks] = np.arange(len(blocks))
        has[blocks] = True
        if w > 0:
            bound[blocks] += w if plain else w * tops
        parts.append((w, place, np.append(begins, len(docs)), docs, gains))
    top_scores, top_docs, seen = np.zeros(0), np.zeros(0, np.int64), 0
    for b in np.argsort(-bound, kind="stable"):
        if not has[b]:
            continue
        if len(top_scores) == k and bound[b] < top_scores[-1] - SLACK:
            break
        seen += 1
        score, hit = np.zeros(block), np.zeros(block, bool)
        for w, place, begins, docs, gains in parts:
            if (p := place[b]) >= 0:
                own = slice(begins[p], begins[p + 1])
                at = docs[own] - b * block
                score[at] += w if plain else w * gains[own]
                hit[at] = True
        at = np.flatnonzero(hit)
        scores, found = np.concatenate([top_scores, np.maximum(np.round(score[at], 6), 0.0)]), np.concatenate([top_docs, at + b * block])
        order = np.lexsort((found, -scores))[:k]
        top_scores, top_docs = scores[order], found[order]
    return top_scores, top_docs, seen


@dataclass(frozen=True)
class Index:
    """A stored index: its table, and the totals that weights of terms depend on."""

    spark: SparkSession
    root: str
    name: str
    docs: int
    mean_idf: float
    block: int

    def weights(self, queries: DataFrame, query_id: str = "query_id", query: str = "query", plain: bool = False) -> list[tuple[int, str, float]]:
        """(query, term, weight) for the terms that the index has. ``queries`` is a stated set; over ``MOST`` different terms it is refused.

        idf = ln(N - n + .5) - ln(n + .5), a negative one becomes a quarter of the mean over all terms; a term weighs as often as it is repeated.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        if (terms := asked.select("term").distinct().limit(MOST + 1)).count() > MOST:
            raise ValueError(f"over {MOST} terms; ask in blocks")
        known = self.spark.read.parquet(f"{self.root}/terms").join(F.broadcast(terms), "term", "left_semi")
        raw = F.log(self.docs - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
        weight = F.lit(1.0) if plain else F.col("qtf") * F.when(raw < 0, FLOOR * self.mean_idf).otherwise(raw)
        # asked rows are bounded as the queries are, and known terms by the asked ones
        return [(r["query_id"], r["term"], r["w"]) for r in asked.join(F.broadcast(known), "term").select("query_id", "term", weight.alias("w")).orderBy("query_id", "term").collect()]

    def search(self, queries: DataFrame, k: int, plain: bool = False, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query that have a term of it; equal scores go by identifier.

        ``plain`` counts shared terms instead of BM25.
        """
        asked: dict[int, list[tuple[str, float]]] = {}
        for q, term, w in self.weights(queries, query_id, query, plain):
            asked.setdefault(q, []).append((term, w))
        sent, block = self.spark.sparkContext.broadcast(asked), self.block
        terms = self.spark.createDataFrame([(t,) for t in sorted({t for ts in asked.values() for t, _ in ts} | {""})], "term string")

        def find(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            ids, rows, place = None, {}, {}
            columns = [group[c].combine_chunks() for c in ("blocks", "tops", "begins", "docs", "gains")]
            for j, term in enumerate(group["term"].to_pylist()):
                if term == "":
                    ids = group["ids"].combine_chunks()[j].values
                else:
                    place[term] = j
                    rows[j] = tuple(c[j].values.to_numpy() for c in columns)
            out_q, out_s, out_d = [], [], []
            for q, own in sent.value.items():
                here = [(w, place[t]) for t, w in own if t in place]
                if here:
                    scores, docs, _ = best(here, rows, ids, k, block, plain)
                    out_q.append(np.full(len(docs), q, np.int64))
                    out_s.append(scores)
                    out_d.append(docs)
            cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
            return pa.table([pa.array(cat(out_q, np.int64)), ids.take(pa.array(cat(out_d, np.int64))), pa.array(cat(out_s, np.float64))], names=["query_id", "doc_id", "score"])

        postings = self.spark.table(self.name).join(F.broadcast(terms), "term", "left_semi")
        hits = postings.groupBy("shard").applyInArrow(find, "query_id long, doc_id long, score double")
        if plain:
            hits = hits.withColumn("score", F.col("score").cast("long"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    def drop(self) -> None:
        """Deletes the stored index."""
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _labels(spark: SparkSession, n: int) -> DataFrame:
    """slot, shard: numbers of shards of which each has one of ``n`` buckets for itself, so that a task sorts one shard, however many there are."""
    tried = 16 * n
    while True:
        slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("slot")  # as Spark deals buckets and partitions
        rows = spark.range(tried).groupBy(slot).agg(F.min("id").cast("int").alias("shard")).collect()
        if len(rows) == n:
            return spark.createDataFrame(rows, "slot int, shard int")
        tried *= 2


def build(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, block: int = BLOCK) -> Index:
    """Index of ``docs`` in the folder ``root``, which driver and executors share.

    Texts are read once; counts of terms are stored, then dealt to shards. Every row is a document of its own, null identifiers included.
    """
    spark = docs.sparkSession
    _counted(docs, doc_id, text).write.mode("overwrite").parquet(f"{root}/counted")
    counted = spark.read.parquet(f"{root}/counted")
    total = counted.agg(F.count("*").alias("n"), F.sum("len").alias("len")).first()
    n, avgdl = total["n"], (total["len"] / total["n"] if total["n"] and total["len"] else 1.0)
    shards = max(-(-n // shard), min(spark.sparkContext.defaultParallelism, -(-n // block)), 1)
    slot = F.pmod(F.xxhash64("doc_id", "len"), F.lit(shards)).cast("int").alias("slot")
    dealt = counted.select("*", slot).join(F.broadcast(_labels(spark, shards)), "slot").drop("slot").repartition(shards, "shard")
    made = dealt.groupBy("shard").applyInArrow(_sharded(avgdl, block), _ROW)
    name = f"textloom_index_{uuid.uuid4().hex}"
    made.write.mode("overwrite").bucketBy(shards, "shard").option("path", f"{root}/postings").format("parquet").saveAsTable(name)
    spark.table(name).where("term <> ''").groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("n")).write.mode("overwrite").parquet(f"{root}/terms")
    idf = F.log(n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    mean = spark.read.parquet(f"{root}/terms").agg(F.avg(idf)).first()[0] or 0.0
    # the totals come last: an index without them is not one
    spark.createDataFrame([(n, mean, shards, block)], "docs long, mean_idf double, shards int, block int").coalesce(1).write.mode("overwrite").parquet(f"{root}/totals")
    _delete(spark, f"{root}/counted")
    return Index(spark, root, name, n, mean, block)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stored(spark: SparkSession, root: str) -> Index | None:
    """The index in a folder, if one was finished there."""
    if not _exists(spark, f"{root}/totals/_SUCCESS"):
        return None
    t = spark.read.parquet(f"{root}/totals").first()
    name = f"textloom_index_{hashlib.md5(root.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table {name} ({_ROW}) using parquet clustered by (shard) into {t['shards']} buckets location '{root}/postings'")
    return Index(spark, root, name, t["docs"], t["mean_idf"], t["block"])


def of(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of a table's files, built when first asked for; other files, sizes or times of change give another one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    told, status = fs.getContentSummary(at), fs.getFileStatus(at)
    seen = f"{status.getPath()}|{told.getLength()}|{told.getFileCount()}|{status.getModificationTime()}|{doc_id}|{text}|{K1}|{B}"
    root = f"{shared_root(spark)}/textloom-index-{hashlib.md5(seen.encode()).hexdigest()}"
    return stored(spark, root) or build(spark.read.parquet(path), root, doc_id, text)
