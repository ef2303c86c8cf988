"""The stored index against plain scoring."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import index

KIND = "doc_id long, text string, lang string, rank int, score double, term string"


def corpus(n: int = 240):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(1, 60)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "W1 w1, W59!"), (None, "w59 w58 w57"), (n + 3, docs[5][1]), (n + 4, docs[5][1])]


def brute(docs, queries, k, plain=False):
    toks = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs]
    n, avgdl, df = len(docs), sum(len(t) for _, t in toks) / len(docs), Counter(w for _, t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    out = []
    for q, text in queries:
        asked = Counter(re.findall("[a-z0-9]+", text.lower()))
        rows = []
        for i, t in toks:
            tf = Counter(t)
            if met := [w for w in asked if tf[w]]:
                s = len(met) if plain else max(round(sum(asked[w] * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in met), 6), 0.0)
                rows.append((-s, -1 if i is None else i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["score"], r["rank"]) for r in df.collect())


QUERIES = [(1, "w0 w1 w2"), (2, "w59 w58 w59 w3"), (3, "nothing known"), (4, "w10 W20, w30 w40 unknown"), (5, "w0"), (6, "")]


@pytest.mark.parametrize(("shard", "block"), [(50, 8), (1000, 512), (40, 1)])
def test_search_matches_plain_scoring(spark, tmp_path, shard, block):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "en", 1, 0.5, "x") for i, t in docs], KIND)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    made = index.build(frame, f"file://{tmp_path}/i", shard=shard, block=block)
    for plain in (False, True):
        for k in (1, 7, 500):
            have, want = got(made.search(asked, k, plain)), brute(docs, QUERIES, k, plain)
            assert [(q, i, r) for q, i, _, r in have] == [(q, i, r) for q, i, _, r in want]
            assert np.allclose([x[2] for x in have], [x[2] for x in want], atol=2e-6)
    again = index.stored(spark, f"file://{tmp_path}/i")
    assert got(again.search(asked, 7)) == got(made.search(asked, 7))
    plan = made.search(asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the shards' best rows alone
    made.drop()
    assert index.stored(spark, f"file://{tmp_path}/i") is None


def test_blocks_that_cannot_win_are_passed_over():
    """A rare term is in one block; the others are bounded below the best."""
    block, n = 16, 160
    common = (np.arange(10), np.full(10, 1.0), np.arange(10) * 16, np.arange(n), np.linspace(0.5, 1.0, n))
    common[1][:] = [common[4][i * 16 : i * 16 + 16].max() for i in range(10)]
    rare = (np.array([3]), np.array([2.0]), np.array([0]), np.array([50]), np.array([2.0]))
    scores, docs, seen = index.best([(0.1, 0), (5.0, 1)], {0: common, 1: rare}, np.arange(n - 1), 1, block, False)
    assert docs.tolist() == [50] and seen == 1 and scores[0] == pytest.approx(10 + 0.1 * common[4][50], abs=1e-6)


def test_index_of_no_documents(spark, tmp_path):
    frame = spark.createDataFrame([], KIND)
    made = index.build(frame, f"file://{tmp_path}/i")
    assert made.search(spark.createDataFrame(QUERIES, "query_id long, query string"), 3).collect() == []


def test_an_index_follows_its_files(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    asked = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    kind = "doc_id long, text string"
    spark.createDataFrame([(1, "apple"), (2, "pear"), (3, "plum"), (4, "fig")], kind).write.parquet(at)
    first = index.of(spark, at)
    assert [r["doc_id"] for r in first.search(asked, 3).collect()] == [1] and index.of(spark, at).root == first.root
    spark.createDataFrame([(5, "apple tree")], kind).write.mode("append").parquet(at)
    assert {r["doc_id"] for r in index.of(spark, at).search(asked, 3).collect()} == {1, 5}


def test_a_task_sorts_one_shard(spark, tmp_path):
    """Buckets, and so tasks, hold a shard each: the largest does not grow with the number of shards."""
    frame = spark.createDataFrame([(i, f"w{i % 7} w{i}") for i in range(600)], "doc_id long, text string")
    made = index.build(frame, f"file://{tmp_path}/i", shard=20, block=10)
    shards = spark.table(made.name).select("shard").distinct()
    buckets = shards.groupBy(F.pmod(F.hash("shard"), F.lit(30))).count().collect()
    assert len(buckets) == 30 and all(r["count"] == 1 for r in buckets)
    at = [f.rsplit("_", 1)[1] for f in os.listdir(tmp_path / "i" / "postings") if f.endswith(".parquet")]
    assert len(at) == len(set(at)) == 30  # a file a bucket
    made.drop()


def test_a_full_shard_fits_a_task():
    """Four tasks of an executor build full shards of documents with 230 different words within 2 GB of Python."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from textloom.operators import index as I
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n, per, r = I.SHARD, 230, np.random.default_rng(0)
ends = pa.array(np.arange(n + 1, dtype=np.int32) * per)
words = pa.array([f'w{i}' for i in range(40000)]).take(pa.array(r.integers(0, 40000, n * per)))
group = pa.table([pa.array(np.arange(n)), pa.array(np.full(n, per)), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(np.ones(n * per, np.int64)))], names=['doc_id', 'len', 'terms', 'tfs'])
before = peak()
assert len(I._sharded(230.0, I.BLOCK)((pa.scalar(0),), group)) == 40001
print(peak() - before)
"""
    took = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert took < 500_000
