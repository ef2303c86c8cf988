"""Best ranked sentences within a task and over tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from textloom.operators import summarize as S
from textloom.queries import summaries

from .test_ranks import matrix, texts


def test_best_in_a_task_is_that_of_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(S, "TOGETHER", 60, raising=False)
    docs = spark.createDataFrame([*texts().items(), (200, ["\x0b"]), (201, [])], "k long, s array<string>").coalesce(1)
    got = S.best_sentences(docs, "k", "s", rounds=7)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r["k"]: (r["sentences"], r["pos"], r["rank"]) for r in got.collect()}
    assert set(rows) == set(texts())
    for k, ss in texts().items():
        rank = matrix(ss, 7)
        best = min(range(len(ss)), key=lambda i: (-round(rank[i], 9), i))
        assert rows[k][:2] == (len(ss), best) and abs(rows[k][2] - rank[best]) < 1e-12


def test_long_texts_and_others_have_equal_ranks(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(" ".join(r.choices(words, k=r.randint(6, 12))).capitalize() + "." for _ in range(n))
    rows = [(k, prose(r.randint(1, 25))) for k in range(40)] + [(50, None), (51, ""), (52, "Two words.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for long in (10**6, 700, 0):
        monkeypatch.setattr(summaries, "LONG", long, raising=False)
        found.append(sorted(tuple(x) for x in summaries.sentence_ranks(spark, str(tmp_path)).collect()))
    assert len(found[0]) == 40 and found[0] == found[1] == found[2]


def test_summaries_of_a_batch_are_those_of_each_text(spark):
    rows = [(k, ss) for k, ss in texts().items()] + [(300, None), (301, [])]
    df = spark.createDataFrame(rows, "k long, s array<string>").coalesce(1)
    got = {r["k"]: r["x"] for r in df.select("k", S.textrank(F.col("s"), 12).alias("x")).collect()}
    assert got == {k: " ".join(S._within(ss, S.textrank_order(ss), 12)) if ss else "" for k, ss in rows}
