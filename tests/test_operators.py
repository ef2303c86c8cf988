from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import entities as E
from textloom.operators import joins as J
from textloom.operators import metrics as M
from textloom.operators import quality as Q
from textloom.operators import retrieval as R
from textloom.operators import routing as X
from textloom.operators import sequences as S
from textloom.operators import variants as V
from textloom.operators.spelling import correct, vocabulary


def test_rule_entities(spark):
    text = "Paid Rs 1,500.50 on 12/03/2024, a 5% fee; call 9876543210 about ABC-1234."
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(E.rule_entities("t")).alias("e")).select("e.*").collect()
    assert {(r["label"], r["text"]) for r in got} == {("AMOUNT", "Rs 1,500.50"), ("DATE", "12/03/2024"), ("PERCENT", "5%"), ("PHONE", "9876543210"), ("ID", "ABC-1234")}
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)


def test_span_scores_exact_and_shifted(spark):
    kind = "doc_id long, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "B")], kind)
    pred = spark.createDataFrame([(1, 0, 5, "A"), (1, 12, 17, "B")], kind)
    got = {r["kind"]: r["f1"] for r in E.span_scores(pred, gold).collect()}
    assert got == {"strict": 0.5, "relaxed": 1.0}


def test_bio_round_trip(spark):
    toks = spark.createDataFrame([(1, i, 4 * i, 4 * i + 3) for i in range(6)], "doc_id long, pos int, start int, end int")
    spans = spark.createDataFrame([(1, 0, 7, "A"), (1, 8, 11, "A"), (1, 16, 23, "B")], "doc_id long, start int, end int, label string")
    tags = E.to_bio(toks, spans)
    assert [r["tag"] for r in tags.orderBy("pos").collect()] == ["B-A", "I-A", "B-A", "O", "B-B", "I-B"]
    back = S.bio_decode(tags, ["doc_id"], "pos", "tag")
    assert sorted((r["label"], r["first"], r["last"]) for r in back.collect()) == [("A", 0, 1), ("A", 2, 2), ("B", 4, 5)]


def test_sequences_are_dealt_over_tasks_by_their_rows(spark):
    tags = spark.range(100).selectExpr("id as doc_id", "explode(array('B-A', 'I-A', 'O', 'I-B')) as gold").withColumn("pos", F.monotonically_increasing_id())
    assert S.bio_decode(tags, ["doc_id"], "pos", "gold", per_task=40).rdd.getNumPartitions() == 10


def test_sequence_scores_need_no_join(spark):
    tags = spark.createDataFrame([(1, 0, "B-A", "B-A"), (1, 1, "I-A", "O"), (1, 2, "B-B", "B-B"), (2, 0, "I-B", "B-B"), (2, 1, None, "I-B"), (None, 0, "B-A", "B-A")], "id long, pos int, gold string, pred string")
    out = E.sequence_scores(tags, ["id"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    # a sequence without an identifier meets none, as in a join
    assert {r["label"]: (r["predicted"], r["gold"], r["correct"]) for r in out.collect()} == {"A": (2, 2, 0), "B": (2, 2, 1), "ALL": (4, 4, 1)}


def test_merge_keeps_rules_first(spark):
    kind = "a array<struct<start:int,end:int,label:string,text:string>>, b array<struct<start:int,end:int,label:string,text:string>>"
    df = spark.createDataFrame([([(0, 4, "R", "x")], [(2, 6, "M", "y"), (8, 9, "M", "z")])], kind)
    assert [r["text"] for r in df.select(E.merge(F.col("a"), F.col("b")).alias("m")).first()["m"]] == ["x", "z"]


def test_roll_up_beats_a_single_label(spark):
    probs = spark.createDataFrame([(1, "a1", 0.3), (1, "a2", 0.3), (1, "b1", 0.35), (1, "q", 0.05)], "row_id long, label string, p double")
    parents = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "label string, parent string")
    got = {r["parent"]: r["p"] for r in J.roll_up(probs, parents).collect()}
    assert got == {"a": 0.6, "b": 0.35, "out_of_scope": 0.05}


def test_strict_lookup_reports_misses(spark):
    left = spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(J.MissingKeys, match="y"):
        J.strict(left, spark.createDataFrame([("x", 1)], "k string, v int"), "k")


def test_calibration_and_mcnemar(spark):
    right = spark.createDataFrame([(1.0, True)] * 5 + [(0.0, False)] * 5, "conf double, correct boolean")
    assert M.calibration_error(right).first()["ece"] == 0.0
    wrong = spark.createDataFrame([(0.9, False)] * 10, "conf double, correct boolean")
    assert M.calibration_error(wrong).first()["ece"] > 0.8
    pairs = spark.createDataFrame([(True, False)] * 30 + [(False, True)] * 8, "a boolean, b boolean")
    assert M.mcnemar(pairs, "a", "b").first()["p"] == pytest.approx(0.000471987, abs=1e-8)
    assert M.mcnemar(pairs, "a", "a").first()["p"] == 1.0


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(i, int(i < 80)) for i in range(100)], "k long, x int")
    r = M.bootstrap(df, "x", "k", 300).first()
    assert r["low"] < 0.8 < r["high"] and r["high"] - r["low"] < 0.25


@pytest.mark.parametrize(
    ("scope", "p", "q", "missing", "action"),
    [(False, 0.9, 0.9, 0, "reject"), (True, 0.2, 0.9, 0, "clarify"), (True, 0.9, 0.2, 0, "human_review"), (True, 0.9, 0.9, 2, "request_details"), (True, 0.9, 0.9, 0, "auto_route")],
)
def test_decisions(spark, scope, p, q, missing, action):
    df = spark.createDataFrame([(scope, p, q, missing)], "s boolean, p double, q double, m int")
    assert df.select(X.decide(F.col("s"), F.col("p"), F.col("q"), F.col("m"))["action"]).first()[0] == action


def test_validation(spark):
    df = spark.createDataFrame([("",), ("   ",), ("x" * 1001,), ("fine",), (None,)], "text string")
    assert [r["error"] for r in X.validate(df).collect()] == ["blank", "blank", "too long", None, "blank"]


def test_spelling_of_long_words_and_two_edits(spark, tmp_path):
    from textloom.queries.text import spell_correct

    known = ["retrieval", "information", "planet", "plan"]
    asked = {"informtion": "information", "retreivl": "retrieval", "rertieavl": "retrieval", "plaxxt": "planet", "pxaxn": "pxaxn", "zzzzzzzz": "zzzzzzzz"}
    spark.createDataFrame([(" ".join(known * 50), "en")], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(" ".join(asked),)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["w"]: r["fixed"] for r in spell_correct(spark, str(tmp_path)).collect()} == asked


def test_spelling(spark):
    vocab = vocabulary(spark.createDataFrame([("semester",)] * 5 + [("exam",)] * 4 + [("exams",)] * 2, "w string"), 2)
    asked = spark.createDataFrame([("semseter",), ("exm",), ("exams",), ("zzz",)], "w string")
    assert {r["w"]: r["fixed"] for r in correct(asked, vocab).collect()} == {"semseter": "semester", "exm": "exam", "exams": "exams", "zzz": "zzz"}


def test_first_seen_mode_and_budget(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "g int, v string, pos int")
    assert J.first_seen_mode(df, ["g"], "v", "pos").first()["v"] == "b"
    cost = spark.createDataFrame([(1, i, c) for i, c in enumerate((200, 1, 1))], "g int, pos int, c int")
    assert S.budget(cost, ["g"], ["pos"], "c", 50).count() == 1


def test_lines_by_running_edge(spark):
    boxes = spark.createDataFrame([(1, 0.0, 10.0), (1, 4.0, 8.0), (1, 12.0, 20.0), (1, 15.0, 18.0)], "p int, top double, bottom double")
    assert [r["line"] for r in S.lines(boxes, ["p"], "top", "bottom", []).orderBy("top").collect()] == [1, 1, 2, 2]


def test_fusion_and_metrics(spark):
    kind = "query_id long, doc_id long, rank long"
    fused = {r["doc_id"]: r["score"] for r in R.fuse(spark.createDataFrame([(1, 5, 1), (1, 6, 2)], kind), spark.createDataFrame([(1, 6, 1)], kind)).collect()}
    assert fused[6] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8) and fused[5] == pytest.approx(1 / 61, abs=1e-8)
    r = R.recall_mrr(spark.createDataFrame([(1, 5, 2)], kind), spark.createDataFrame([(1, 5), (2, 7)], "query_id long, doc_id long"), (1, 3)).first()
    assert (r["recall_1"], r["recall_3"], r["mrr"]) == (0.0, 0.5, 0.25)


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(g, "s", i) for g in range(40) for i in range(3)], "g long, s string, i int")
    split = V.group_split(df, "g", "s")
    assert split.count() == 40
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 28, "validation": 6, "test": 6}
    assert Q.leaks(df.join(split.select("g", "split"), "g"), "g", "split").count() == 0


def test_markdown(spark):
    assert Q.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_models_save_and_load(spark, tmp_path):
    from textloom.operators import learning as L

    rows = [(i, ("pay the fee now " if i % 2 else "open the hall door ") + f"w{i}", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    fitted = L.features(n=256).fit(df)
    L.save(fitted, str(tmp_path / "m"))
    assert L.load(str(tmp_path / "m")).transform(df).count() == 40
    with pytest.raises(L.ModelMissing):
        L.load(str(tmp_path / "none"))
    folds = L.cross_validate(df, "complement_nb", "id", folds=2)
    assert folds.count() == 40 and folds.where("label = prediction").count() == 40
    weights = {r["label"]: r["weight"] for r in L.balanced(df.where("id < 30")).select("label", "weight").distinct().collect()}
    assert weights == {0.0: 1.0, 1.0: 1.0}


def test_compared_models_share_their_features(spark, monkeypatch):
    from textloom.catalog import QUERIES
    from textloom.queries import learning

    calls, real = [], learning.L.features
    monkeypatch.setattr(learning.L, "features", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert QUERIES["model_comparison"](spark, "/root/testdata/sf0.001").count() == 2
    assert len(calls) == 1


def test_texts_are_cut_once_for_all_folds(spark):
    """What is fitted reads stored counts: a text that is cut tells so, and is cut once."""
    from textloom.operators import learning as L

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([(i, float(i % 2), ("cat dog" if i % 2 else "bond rate") + f" {i}") for i in range(40)], "id long, label double, text string")
    out = L.cross_validate(rows.withColumn("text", told("text")), "complement_nb", "id", folds=3)
    assert out.count() == 40 and out.where("label = prediction").count() == 40
    assert seen.value == 40
