"""Ranks of sentences, in one task and over tables, against the matrix of all pairs."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from textloom.operators import summarize as S


def matrix(sentences, rounds):
    x = S._bags(sentences)
    w = x @ x.T
    np.fill_diagonal(w, 0)
    total = w.sum(axis=1, keepdims=True)
    step = np.divide(w, total, out=np.full_like(w, 1 / len(w)), where=total > 1e-12)
    rank = np.full(len(w), 1 / len(w))
    for _ in range(rounds):
        rank = (1 - S.DAMPING) / len(w) + S.DAMPING * step.T @ rank
    return rank


def texts():
    r = random.Random(8)
    return {k: [" ".join(r.choices([f"w{i}" for i in range(25)], k=r.randint(1, 8))) for _ in range(r.randint(1, 30))] + ["alone here"] * (k % 2) for k in range(12)} | {90: ["one"], 91: ["a b", "c d"]}


def test_order_is_that_of_the_matrix():
    for ss in texts().values():
        rank = matrix(ss, S.ROUNDS)
        assert S.textrank_order(ss) == sorted(range(len(ss)), key=lambda i: (-round(rank[i], 9), i))
    assert S.textrank_order([]) == []


def test_ranks_over_tables(spark, tmp_path):
    docs = spark.createDataFrame(list(texts().items()), "k long, s array<string>")
    got = {(r["k"], r["pos"]): r["rank"] for r in S.ranks(S.sentence_bags(docs, "k", "s"), "k", "pos", f"file://{tmp_path}/r", rounds=7, store=3).collect()}
    for k, ss in texts().items():
        assert [got[k, i] for i in range(len(ss))] == pytest.approx(matrix(ss, 7).tolist(), abs=1e-12)


def test_a_text_of_very_many_sentences():
    """All pairs of 20,000 sentences would be 3.2 GB."""
    r = random.Random(9)
    ss = [" ".join(r.choices([f"w{i}" for i in range(3000)], k=12)) for _ in range(20_000)]
    start = time.time()
    assert sorted(S.textrank_order(ss)) == list(range(20_000)) and time.time() - start < 60
