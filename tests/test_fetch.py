"""Fetching with planted faults, and a log that a failed job leaves as it was."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from textloom.sources import fetch as G


def test_faults_are_rows(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html>x</html>")
    (tmp_path / "b").write_bytes(b"%PDF-1.4")
    urls = [(1, f"file://{tmp_path}/a.html"), (2, f"file://{tmp_path}/b"), (3, f"file://{tmp_path}/none"), (4, None), (5, "nonsense"), (6, "data:,hello"), (1, f"file://{tmp_path}/a.html")]
    df = spark.createDataFrame([(i, u, "x", 3) for i, u in urls], "id long, url string, kind2 string, attempts2 int")
    rows = G.fetch(df, keep=("id",), delay=0.01, retries=1).collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == 7 and [got[i]["kind"] for i in (1, 2, 6)] == ["html", "pdf", "text"] and got[6]["body"] == b"hello" and got[6]["bytes"] == 5
    assert all(got[i]["body"] is None and got[i]["error"] for i in (3, 4, 5)) and got[3]["attempts"] == 2 and got[4]["attempts"] == 1 and got[1]["error"] is None
    assert G.fetch(df.limit(0), keep=("id",)).count() == 0


def test_retries_and_delay(spark, tmp_path):
    log = str(tmp_path / "calls")

    def flaky(url, timeout):
        with open(log, "a") as f:
            f.write(f"{url} {time.time()}\n")
        with open(log) as f:
            if sum(line.startswith(url + " ") for line in f) < 3:
                raise TimeoutError("slow")
        return b"body", "Mon, 01 Jan 2024 00:00:00 GMT"

    df = spark.createDataFrame([("http://one/a",), ("http://one/b",)], "url string")
    rows = G.fetch(df, delay=0.1, retries=2, open_with=flaky).collect()
    assert [r["attempts"] for r in rows] == [3, 3] and all(r["error"] is None and r["created"] for r in rows)
    with open(log) as f:
        at = sorted(float(line.split()[1]) for line in f)
    assert all(b - a >= 0.09 for a, b in zip(at, at[1:]))  # one stream to one host


def test_log_is_whole_or_absent(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    assert G.read_log(spark, at) is None
    G.write_log(spark.range(10).withColumn("x", F.lit("a")).repartition(3), at)
    G.write_log(spark.range(10, 15).withColumn("x", F.lit("b")), at)
    with pytest.raises(Exception, match="planted"):
        G.write_log(spark.range(20, 30, 1, 4).withColumn("x", F.when(F.col("id") == 27, F.raise_error(F.lit("planted"))).otherwise("c")), at)
    (tmp_path / "log" / "stray.parquet").write_bytes(b"of a task that was run twice")
    rows = G.read_log(spark, at).collect()
    assert sorted(r["id"] for r in rows) == list(range(15)) and {r["x"] for r in rows} == {"a", "b"}
    G.write_log(spark.range(0).withColumn("x", F.lit("d")), at)
    assert G.read_log(spark, at).count() == 15
    assert sum(f.startswith("manifest") for f in os.listdir(tmp_path / "log")) == 3
