"""Spelling variants against plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from textloom.llm import variants
from textloom.llm.common import Workspace

from .helpers import frame, prose, texts


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return grouped({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def grouped(n):
    form, rows = {}, {}
    for w in n:
        close = sorted((o for o in n if one_edit(w, o)), key=lambda o: (-n[o], o))
        form[w] = close[0] if close and n[close[0]] >= 2 * n[w] else None
        rows[w] = len(close)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return out


def result(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus():
    r, docs = random.Random(11), texts()
    base = [prose(500 + k, 3).replace(" ", "") for k in range(40)] + ["straße", "naïveté", "aaaaa", "aaaaaa", "aaaaaaa", "Ångström", "a×b÷cdef"]
    for k in range(400):
        some = []
        for _ in range(30):
            w = base[min(int(r.expovariate(0.1)), len(base) - 1)]
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at + 1 :], w[:at] + "é" + w[at:]])
            some.append(w if r.random() < 0.8 else w.upper())
        docs.append((None if k % 50 == 0 else k, r.choice([" ", "-", "1", "\n"]).join(some)))
    return docs


def test_variants_match_plain_loops(spark):
    docs = corpus()
    want = brute(docs)
    assert sum(w[1] is not None for w in want) > 00 and sum(w[1] != w[2] and w[1] is not None for w in want) > 0
    with Workspace(spark, "t") as ws:
        assert result(variants.group(ws, variants.words(frame(spark, docs)))) == want
    with Workspace(spark, "t") as ws:
        assert variants.group(ws, variants.words(frame(spark, []))).count() == 0


def test_sql_gives_the_same(spark, tmp_path):
    docs = corpus()
    frame(spark, docs).select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d.parquet'")
    cur = con.execute(variants.SQL)
    names = [c[0] for c in cur.description]
    got = {tuple(dict(zip(names, r))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in cur.fetchall()}
    assert got == brute(docs)


def test_keys_are_shared_by_words_one_edit_apart_alone():
    r = random.Random(12)
    words = list({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(600)})
    own = {w: set(variants.deletion_keys(w).tolist()) for w in words}
    for w in words:
        assert len(own[w]) == 1 + len({w[:i] + w[i + 1 :] for i in range(len(w))})
    for a in words[:150]:
        for b in words:
            if one_edit(a, b):
                assert own[a] & own[b]
            elif abs(len(a) - len(b)) > 1:
                assert not own[a] & own[b]


def test_chains_hubs_and_very_long_words(spark):
    long = "".join(random.Random(13).choice("abcdefgh") for _ in range(50_000))
    n = {"chain" + "x" * k: 3 * 2**k for k in range(14)}
    n |= {f"{a}{b}center": 4 for a in "bcdfghjklm" for b in "abcdefghij"} | {"center": 9, "acenter": 30, "aacenter": 90}
    n |= {long: 50, long[:777] + long[778:]: 3, long[:49_000] + "z" + long[49_001:]: 4, long + "q": 5, long[::-1]: 3}
    rows = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    with Workspace(spark, "t") as ws:
        assert result(variants.group(ws, rows)) == grouped(n)


def test_no_rows_by_pairs_of_a_crowd(spark):
    """A frequent letter pattern does not multiply: keys of a word stay its own length plus one."""
    r = np.random.default_rng(3)
    words = list({"".join(map(chr, 97 + r.integers(0, 26, 9))) for _ in range(3000)})
    listed = spark.createDataFrame(list(enumerate(words)), "wid long, word string")
    emitted = variants.keys(listed)
    assert emitted.count() <= 10 * len(words) and emitted.groupBy("key").count().agg(F.max("count")).first()[0] < 10
