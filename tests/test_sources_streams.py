from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from textloom.sources import readers as S
from textloom.sources import writers as W
from textloom.streaming import events as E

DATA = "/root/testdata/sf0.001"


def test_csv_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in S.csv(spark, str(tmp_path / "a.csv"), "id int, name string").orderBy("id").collect()] == [(1, "x, y"), (2, None)]
    assert [r["name"] for r in S.csv(spark, str(tmp_path / "a.csv"), "id int, name string", False).orderBy("id").collect()] == ["x, y", ""]


def test_lines_json_yaml_folder(spark, tmp_path):
    (tmp_path / "l.txt").write_text("b\n\n  a \n")
    rows = S.numbered(S.lines(spark, str(tmp_path / "l.txt"))).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(1, "a"), (2, "b")]
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert S.json_lines(spark, str(tmp_path / "j.json"), "a int").count() == 2
    assert S.yaml_rows(spark, "- {a: 1, b: [x]}\n- {a: 2, b: []}", "a int, b array<string>").count() == 2
    assert (S.as_list(None), S.as_list("x"), S.as_list(["x"])) == ([], ["x"], ["x"])
    (tmp_path / "docs" / "topic_one").mkdir(parents=True)
    (tmp_path / "docs" / "topic_one" / "first_steps.txt").write_text("hello")
    r = S.folder(spark, str(tmp_path / "docs")).first()
    assert (r["topic"], r["name"], r["text"]) == ("topic_one", "First Steps", "hello")


def test_spans_must_occur(spark):
    texts = spark.createDataFrame([(1, "pay the fee")], "id int, text string")
    assert S.located(spark.createDataFrame([(1, "fee")], "id int, span string"), texts, "id").select("start", "end").first() == (8, 11)
    with pytest.raises(PySparkException):
        S.located(spark.createDataFrame([(1, "tax")], "id int, span string"), texts, "id").collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "train"), (2, [], "test")], "id int, tags array<string>, split string")
    W.by_split(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=train")).count() == 1
    W.csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("id = 1").first()["tags"] == "a|b"
    assert json.loads(W.schema_json(t=df))["t"]["fields"][0]["name"] == "id"
    assert S.contract_errors(df, {"id": "int", "x": "string", "split": "int"}) == ["x: missing", "split: string is not int"]


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams_match_batches(spark):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    got = drain(E.tumbling(E.source(spark, DATA)), "tumbling", "complete")
    assert got.groupBy().sum("n").first()[0] == batch.count()
    assert drain(E.once(E.source(spark, DATA)), "once").count() == batch.count()
    longest = drain(E.streaks(E.source(spark, DATA)), "streaks", "update")
    assert longest.select("user_id").distinct().count() == batch.select("user_id").distinct().count()
