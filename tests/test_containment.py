"""The best row of each query by containment, within tasks and by a join; longest common subsequences."""

from __future__ import annotations

import random

import pytest

from textloom.functions.python_text import rouge_l
from textloom.operators import joins as J


def test_best_rows_are_those_of_plain_loops(spark, monkeypatch):
    r, words = random.Random(6), [f"w{i}" for i in range(50)]
    asked = [(k, r.sample(words, r.randint(1, 20))) for k in range(25)] + [(30, []), (31, ["nowhere"])]
    rows = [(k, r.sample(words, r.randint(0, 40))) for k in range(200)] + [(900, None), (None, words)]
    monkeypatch.setattr(J, "TOGETHER", 300)
    a = spark.createDataFrame(asked, "q long, terms array<string>")
    b = spark.createDataFrame(rows, "doc long, own array<string>")
    want = {}
    for q, ts in asked:
        found = [(-round(n / len(ts) + 1e-12, 6), d is None, d) for d, ws in rows if ts and (n := len({*ts} & {*(ws or ())}))]
        if found:
            want[q] = min(found, key=lambda x: (x[0], x[1], x[2] or 0))
    for most in (None, 10):
        got = J.best_containment(a, b, "q", "terms", "doc", "own", most)
        assert {x["q"]: (x["doc"], x["score"]) for x in got.collect()} == {q: (d, -s) for q, (s, _, d) in want.items()}
        grouped = [p for p in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(q" in p and "doc" in p.split("hashpartitioning")[1].split(")")[0]]
        assert bool(grouped) == (most is not None)


@pytest.mark.parametrize("seed", range(30))
def test_common_subsequences(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcde") for _ in range(r.randint(1, 90))] for _ in range(2))
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    p, q = row[-1] / len(a), row[-1] / len(b)
    assert rouge_l(a, b) == (2 * p * q / (p + q) if p + q else 0.0)
    assert rouge_l([], b) == rouge_l(a, []) == rouge_l(["z"], b) == 0.0


def test_files_come_in_small_batches(spark, tmp_path):
    """A batch of 10,000 pages holds as many files several times over."""
    from textloom.queries.sources import office_round_trip

    conf, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.createDataFrame([(1, "one two"), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    try:
        for given, taken in (("10000", "200"), ("30", "30")):
            spark.conf.set(conf, given)
            assert office_round_trip(spark, str(tmp_path)).count() == 2 and spark.conf.get(conf) == taken
    finally:
        spark.conf.set(conf, was)
