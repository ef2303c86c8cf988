"""Evaluation queries: nearest-neighbour predictions for classes, labels with derived scores for calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..registry import query
from ..session import digest_int, table
from .retrieval import KNN, knn_label_vote

VOTED = KNN + """, votes as (select query_id, label, count(*) as n from knn where rank <= 5 group by all),
winner as (select *, row_number() over (partition by query_id order by n desc, label) as r from votes),
voted as (select query_id, label as pred, gold from winner join (select vec_id as query_id, label as gold from embeddings) using (query_id) where r = 1)
"""
# a score for every label row, from its digest; label 1 is lifted so that the score says something
SCORED = """scored as (select doc_id, quality as gold, round(least(1.0, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) / 4294967296.0 * 0.7 + quality * 0.3), 4) as score,
  (cast('0x' || substr(md5(cast(doc_id as varchar) || '|b'), 1, 8) as bigint) % 10 < 8) as b_right from labels),
judged as (select *, (score >= 0.5) = (gold = 1) as a_right, greatest(score, 1 - score) as conf from scored)"""


def voted(spark, d):
    return knn_label_vote(spark, d).withColumnRenamed("predicted", "pred")


def judged(spark, d):
    u = digest_int(F.col("doc_id").cast("string"))
    s = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold"), F.round(F.least(F.lit(1.0), u / 4294967296.0 * 0.7 + F.col("quality") * 0.3), 4).alias("score"), (digest_int(F.col("doc_id").cast("string"), F.lit("b")) % 10 < 8).alias("b_right"))
    return s.withColumns({"a_right": (F.col("score") >= 0.5) == (F.col("gold") == 1), "conf": F.greatest(F.col("score"), 1 - F.col("score"))})


@query("confusion_matrix", f"with {VOTED} select gold, " + ", ".join(f"count(*) filter (pred = {k}) as \"{k}\"" for k in range(10)) + " from voted group by gold")
def confusion_matrix(spark, d):
    return M.confusion(voted(spark, d), list(range(10)))


PRF = """prf as (select label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
  select gold as label, cast(gold = pred as int) as tp, 0 as fp, cast(gold <> pred as int) as fn from voted union all select pred, 0, cast(gold <> pred as int), 0 from voted) group by label)"""


@query("per_class_prf", f"""
with {VOTED}, {PRF} select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tp + fn as bigint) as support,
  case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1 from prf
""")  # fmt: skip
def per_class_prf(spark, d):
    return M.per_class(voted(spark, d))


@query("macro_f1", f"""
with {VOTED}, {PRF} select cast(sum(tp + fn) as bigint) as n, round(sum(tp) / sum(tp + fn), 6) as accuracy, round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end), 6) as macro_f1 from prf
""")  # fmt: skip
def macro_f1(spark, d):
    return M.macro(voted(spark, d))


@query("ece", f"""
with {SCORED}, b as (select least(floor(round(conf * 10, 9)), 9) as bin, count(*) as n, avg(conf) as c, avg(cast(a_right as double)) as a from judged group by 1)
select cast(sum(n) as bigint) as n, round(sum(n * abs(c - a)) / sum(n), 6) as ece from b
""")  # fmt: skip
def ece(spark, d):
    return M.calibration_error(judged(spark, d), "conf", "a_right")


CURVE = """g as (select conf, count(*) as n, sum(cast(a_right as int)) as hits from judged group by conf),
curve as (select conf as threshold, round(sum(n) over w / (select sum(n) from g), 6) as coverage, round(sum(hits) over w / sum(n) over w, 6) as accuracy from g window w as (order by conf desc rows unbounded preceding))"""


@query("risk_coverage", f"with {SCORED}, {CURVE} select * from curve")
def risk_coverage(spark, d):
    return M.risk_coverage(judged(spark, d), "conf", "a_right")


@query("abstention_threshold", f"with {SCORED}, {CURVE} select min(threshold) as threshold from curve where accuracy >= 0.9")
def abstention_threshold(spark, d):
    return M.abstention_threshold(M.risk_coverage(judged(spark, d), "conf", "a_right"))


@query("mcnemar", f"""
with {SCORED}, s as (select count(*) filter (a_right and not b_right) as only_a, count(*) filter (not a_right and b_right) as only_b from judged),
t as (select only_a, only_b, only_a + only_b as n, least(only_a, only_b) as k from s)
select only_a, only_b, case when n = 0 then 1.0 else round(least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from (select unnest(range(0, k + 1)) as i))), 9) end as p from t
""")  # fmt: skip
def mcnemar(spark, d):
    return M.mcnemar(judged(spark, d), "a_right", "b_right")


@query("bootstrap_ci", f"""
with {SCORED}, r as (select unnest(range(0, 200)) as round),
u as (select round, cast(a_right as int) as x, cast('0x' || substr(md5(cast(doc_id as varchar) || '|' || cast(round as varchar)), 1, 8) as bigint) as u from judged, r),
t as (select round, x, (u >= 1580030168)::int + (u >= 3160060337)::int + (u >= 3950075421)::int + (u >= 4213413783)::int + (u >= 4279248373)::int as times from u),
m as (select round, sum(x * times) / sum(times) as m from t group by round)
select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, count(*) as rounds from m
""")  # fmt: skip
def bootstrap_ci(spark, d):
    return M.bootstrap(judged(spark, d).withColumn("x", F.col("a_right").cast("int")), "x", "doc_id")


GRID = [x / 10 for x in range(1, 10)]
SWEEP = """swept as (select t as threshold, count(*) filter (gold = 1 and score >= t) as tp, count(*) filter (gold <> 1 and score >= t) as fp, count(*) filter (gold = 1) as pos from judged, (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as t) group by t),
metrics as (select threshold, tp, fp, case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0.0 end as precision, case when pos > 0 then round(tp / pos, 6) else 0.0 end as recall, case when tp + fp + pos > 0 then round(2 * tp / (tp + fp + pos), 6) else 0.0 end as f1 from swept)"""


@query("threshold_sweep", f"with {SCORED}, {SWEEP} select * from metrics")
def threshold_sweep(spark, d):
    return M.sweep(judged(spark, d), GRID)


@query("best_threshold", f"with {SCORED}, {SWEEP} select threshold, f1 from metrics order by f1 desc, threshold limit 1")
def best_threshold(spark, d):
    return M.best(M.sweep(judged(spark, d), GRID), "f1", "threshold")


@query("error_slices", f"with {SCORED} select case when score <= 0.25 then 'low' when score <= 0.5 then 'mid' when score <= 0.75 then 'high' else 'top' end as band, count(*) as n, round(1 - avg(cast(a_right as double)), 6) as error_rate from judged group by 1")
def error_slices(spark, d):
    s = F.col("score")
    return M.slices(judged(spark, d), F.when(s <= 0.25, "low").when(s <= 0.5, "mid").when(s <= 0.75, "high").otherwise("top"), "band", "a_right")


@query("confused_pairs", f"with {VOTED} select gold, pred, count(*) as n from voted where gold <> pred group by all order by n desc, gold, pred limit 8")
def confused_pairs(spark, d):
    return M.confused_pairs(voted(spark, d), 8)


@query("latency_percentiles", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def latency_percentiles(spark, d):
    return M.latency(table(spark, d, "events"), "value", ("event_type",))


@query("oov_rate", """
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents), known as (select distinct w from t where doc_id % 5 <> 0)
select count(*) as tokens, count(*) filter (w not in (select w from known)) as unknown, round(count(*) filter (w not in (select w from known)) / count(*), 6) as rate from t where doc_id % 5 = 0
""")  # fmt: skip
def oov_rate(spark, d):
    from ..functions.text import tokens

    words = table(spark, d, "documents").select((F.col("doc_id") % 5 == 0).alias("test"), F.explode(tokens(F.col("text"))).alias("w"))
    by = words.groupBy("w").agg(F.sum(F.col("test").cast("long")).alias("n"), F.max(~F.col("test")).alias("known"))
    unknown = F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0))
    return by.agg(F.sum("n").alias("tokens"), unknown.alias("unknown"), F.round(unknown / F.sum("n"), 6).alias("rate"))


@query("class_weights", "select label, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as balanced, round(sqrt(sum(count(*)) over () / count(*)), 6) as inverse_sqrt from embeddings group by label")
def class_weights(spark, d):
    from ..operators.learning import class_weights as weights

    return weights(table(spark, d, "embeddings"), "label")


@query("majority_baseline", """
with m as (select lang from documents group by lang order by count(*) desc, lang limit 1) select (select lang from m) as predicted, count(*) as n, round(avg(cast(lang = (select lang from m) as double)), 6) as accuracy from documents
""")  # fmt: skip
def majority_baseline(spark, d):
    by = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    top = by.agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("predicted"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    return top.select("predicted", F.col("rows").alias("n"), F.round(F.col("most") / F.col("rows"), 6).alias("accuracy"))
