"""The trained encoder against a full decomposition, and the interface."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import encoding as N


def texts():
    r = random.Random(6)
    topics = [["cat", "dog", "mouse", "bird"], ["stock", "bond", "price", "rate"], ["rain", "snow", "wind", "sun"]]
    return [" ".join(r.choices(topics[k % 3], k=8)) for k in range(45)] + ["", None, "?!", "Cat CAT cat"]


def test_vectors_are_those_of_the_decomposition(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id long, text string").repartition(3)
    enc = N.fit(df, dimensions=3, columns=64, rounds=60)
    told = [N.counts(t, 64) for t in docs]
    freq = np.array([sum(k in c for c in told) for k in range(128)])
    idf = np.log((1 + len(docs)) / (1 + freq)) + 1
    x = np.zeros((len(docs), 128))
    for i, c in enumerate(told):
        for k, v in c.items():
            x[i, k] = (1 + np.log(v)) * idf[k]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = x @ np.linalg.svd(x)[2][:3].T
    got = enc(docs)
    for k in range(3):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-6
    rows = df.select("id", N.encode(lambda: enc)(F.col("text")).alias("v")).collect()
    assert all(np.allclose(r["v"], got[r["id"]]) for r in rows)
    assert not np.any(got[45:48]) and np.linalg.norm(got[0]) > 0.3
    # one topic's texts are closer to each other than to another's
    unit = got[:45] / np.linalg.norm(got[:45], axis=1, keepdims=True)
    assert all(unit[0] @ unit[k] > 0.8 for k in range(3, 45, 3)) and all(unit[0] @ unit[k] < 0.6 for k in range(1, 45, 3))


def test_any_model_is_asked_for_different_texts_alone(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def model(ts):
            with open(log, "a") as f:
                f.writelines(f"text {t}\n" for t in ts)
            return np.array([[len(t), 1.0] for t in ts])

        return model

    df = spark.createDataFrame([(t,) for t in ["aa", "b", "aa", None, "", "  ", "aa"]], "t string").coalesce(1)
    assert [r[0] for r in df.select(N.encode(load)(F.col("t"))).collect()] == [[2, 1], [1, 1], [2, 1], [0, 0], [0, 0], [0, 0], [2, 1]]
    with open(log) as f:
        lines = f.read().splitlines()
    assert sorted(x for x in lines if x.startswith("text")) == ["text aa", "text b"] and len({x for x in lines if x.startswith("load")}) == 1


def test_encoder_of_no_texts(spark):
    enc = N.fit(spark.createDataFrame([], "text string"), dimensions=2, columns=8, rounds=1)
    assert enc(["some", None]).shape == (2, 2)


def plain(text, columns):
    """Every word, pair and n-gram by itself."""
    words = re.findall(r"\w+", (text or "").lower())
    out = Counter(zlib.crc32(x.encode()) % columns for x in [*words, *map(" ".join, zip(words, words[1:]))])
    for w in (f" {w} " for w in words):
        out.update(columns + zlib.crc32(w[i : i + n].encode()) % columns for n in range(2, 6) for i in range(len(w) - n + 1))
    return out


def test_entries_are_those_of_single_words():
    r = random.Random(3)
    told = [*texts(), "a", "a b", "ab\x00c _ 12", "Größe a élan vital 中文 ab", "x" * 3000, "é" * 500]
    told += ["".join(r.choices("ab cdé-", k=r.randrange(60))) for _ in range(200)]
    for t in told:
        for columns in (8, 64, 1 << 12, 1000):
            assert N.counts(t, columns) == plain(t, columns)


def test_texts_are_cut_once(spark, tmp_path):
    """Frequencies, all rounds and the vectors are of stored entries; these go with the context."""
    seen = spark.sparkContext.accumulator(0)

    def told(t):
        seen.add(1)
        return t

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id long, text string").repartition(3)
    read = df.select("id", F.udf(told, "string")("text").alias("text"))
    enc = N.fit(read, dimensions=3, columns=64, rounds=4)
    assert seen.value == len(texts())
    with N.counted(df, columns=64) as made:
        at = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(at)
        again = N.fit_counted(made, dimensions=3, columns=64, rounds=4)
        got = {r["id"]: r["vector"] for r in N.vectors(made, again).collect()}
    assert not os.path.exists(at)
    assert np.allclose(enc.projection, again.projection)
    assert np.allclose([got[i] for i in range(len(texts()))], enc(texts()))
