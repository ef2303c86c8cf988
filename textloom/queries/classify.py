"""Rules, keywords, bands, decisions and eligibility over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import routing as R
from ..plans import analyze
from ..registry import query
from ..session import table
from .metrics import SCORED, judged

RULES = {"article": ["the ", " a "], "german": ["der ", "und ", " die "], "spanish": ["ción", " los ", " que "], "french": [" les ", " des ", " et "]}
ROUTED = "(select doc_id, lower(coalesce(text, '')) as t from documents)"
COUNTS = ", ".join("(" + " + ".join(f"cast(contains(t, '{w}') as int)" for w in ws) + f") as n_{k}" for k, ws in RULES.items())




def labelled_sql(text: str) -> str:
    """The routing label of a text, as SQL."""
    n = {k: "(" + " + ".join(f"cast(contains(lower(coalesce({text}, '')), '{w}') as int)" for w in ws) + ")" for k, ws in RULES.items()}
    top = f"greatest({', '.join(n.values())})"
    return f"case when {top} = 0 then 'out_of_scope' " + " ".join(f"when {x} = {top} then '{k}'" for k, x in n.items()) + " end"


@query("rule_classify", """
select conv_id, turn, case """ + " ".join(f"when regexp_matches(t, '{p}') then '{label}'" for p, label in T.QUESTION_RULES) + " else 'statement' end as kind from (select conv_id, turn, trim(lower(text)) as t from conversations)")  # fmt: skip
def rule_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_type(F.col("text")).alias("kind"))


@query("keyword_route", f"""
with n as (select doc_id, {COUNTS} from {ROUTED}), m as (select *, greatest({", ".join(f"n_{k}" for k in RULES)}) as top, {" + ".join(f"exp(n_{k})" for k in RULES)} as z from n)
select doc_id, case when top = 0 then 'out_of_scope' {" ".join(f"when n_{k} = top then '{k}'" for k in RULES)} end as label, top as score, round(exp(top) / z, 6) as p from m
""")  # fmt: skip
def keyword_route(spark, d):
    return table(spark, d, "documents").select("doc_id", R.route(F.col("text"), RULES).alias("r")).select("doc_id", "r.*")


@query("confidence_bands", f"""
with {SCORED} select case when conf >= 0.75 then 'high' when conf >= 0.5 then 'medium' else 'low' end as level, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share, round(avg(cast(a_right as double)), 4) as accuracy, round(avg(conf), 4) as mean_confidence from judged group by 1
""")  # fmt: skip
def confidence_bands(spark, d):
    by = judged(spark, d).groupBy(R.band(F.col("conf")).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("a_right").cast("double")), 4).alias("accuracy"), F.round(F.avg("conf"), 4).alias("mean_confidence"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("decision_ladder", f"""
with {SCORED}, d as (select doc_id, floor(conf * 100) / 100 as conf, floor(score * 100) / 100 as score, doc_id % 3 as missing, score >= 0.1 as in_scope from judged)
select doc_id, case when not in_scope then 'reject' when conf < 0.3 then 'clarify' when score < 0.5 then 'human_review' when missing > 0 then 'request_details' else 'auto_route' end as action,
  case when not in_scope then 'outside the known topics' when conf < 0.3 then 'topic unclear, confidence ' || printf('%.2f', conf) when score < 0.5 then 'routing confidence ' || printf('%.2f', score) || ' is under 0.50'
  when missing > 0 then cast(missing as varchar) || ' details are missing' else 'routing confidence ' || printf('%.2f', score) end as reason from d
""")  # fmt: skip
def decision_ladder(spark, d):
    cut = lambda c: F.floor(F.col(c) * 100) / 100
    j = judged(spark, d).withColumns({"conf": cut("conf"), "score": cut("score")})
    out = j.select("doc_id", R.decide(F.col("score") >= 0.1, F.col("conf"), F.col("score"), F.col("doc_id") % 3).alias("x"))
    return out.select("doc_id", "x.*")


@query("open_set_rejection", f"with {SCORED} select case when conf < 0.6 then 'out_of_scope' when score >= 0.5 then 'good' else 'bad' end as label, count(*) as n from judged group by 1")
def open_set_rejection(spark, d):
    j = judged(spark, d).select(R.reject(F.when(F.col("score") >= 0.5, "good").otherwise("bad"), F.col("conf"), 0.6).alias("label"))
    return j.groupBy("label").agg(F.count("*").alias("n"))


@query("masked_argmax", """
with p as (select vec_id as row_id, unnest(['a', 'b', 'c', 'out_of_scope']) as label, unnest([round(((vec_id * 7) % 11) / 40.0, 6), round(((vec_id * 5) % 13) / 40.0, 6), round(((vec_id * 3) % 7) / 40.0, 6), 0.9]) as p from embeddings),
r as (select *, row_number() over (partition by row_id order by p desc, label) as k from p where label <> 'out_of_scope')
select row_id, label, p from r where k = 1
""")  # fmt: skip
def masked_argmax(spark, d):
    share = lambda m, n: F.round((F.col("vec_id") * m) % n / 40.0, 6)
    parts = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("p")) for k, v in (("a", share(7, 11)), ("b", share(5, 13)), ("c", share(3, 7)), ("out_of_scope", F.lit(0.9)))])
    probs = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.explode(parts).alias("x")).select("row_id", "x.*")
    return R.best_label(probs, without=("out_of_scope",))


@query("candidate_pool", """
with p as (select vec_id as row_id, label as home, unnest([0, 1, 2, 3]) as label, unnest([0.4, 0.3, 0.2, 0.1]) as p from embeddings),
a as (select *, (label = home) as ok, max(cast(label = home as int)) over (partition by row_id) as any_ok from p)
select row_id, label, p from a where ok or any_ok = 0
""")  # fmt: skip
def candidate_pool(spark, d):
    parts = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("p")) for k, v in ((0, 0.4), (1, 0.3), (2, 0.2), (3, 0.1))])
    probs = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("home"), F.explode(parts).alias("x")).select("row_id", "home", "x.*")
    return R.candidates(probs, F.col("label") == F.col("home")).select("row_id", "label", "p")


@query("input_validation", """
select case when text is null or trim(text) = '' then 'blank' when length(text) > 1000 then 'too long' when not coalesce(turn between 0 and 5, true) then 'turn out of range' else 'ok' end as status, count(*) as n from conversations group by 1
""")  # fmt: skip
def input_validation(spark, d):
    v = R.validate(table(spark, d, "conversations"), ranges={"turn": (0, 5)})
    return v.groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))


@query("eligibility_checks", """
with s as (select l_partkey, count(*) as n, min(l_discount) as low, max(l_tax) as tax, sum(case when l_returnflag = 'R' then 1 else 0 end) as returned from lineitem group by 1),
c as (select p_partkey, case when n is null then 'unknown' when n >= 20 then 'pass' else 'fail' end as demand, case when returned is null then 'unknown' when returned * 4 > n then 'fail' else 'pass' end as returns, case when p_size > 40 then 'partial' else 'pass' end as size, case when p_retailprice > 1500 then 'fail' else 'pass' end as price
  from part left join s on p_partkey = l_partkey)
select case when demand = 'fail' or returns = 'fail' then 'not_eligible' when demand = 'unknown' or returns = 'unknown' then 'needs_review' when size = 'partial' then 'conditional' else 'eligible' end as status, count(*) as parts, count(*) filter (price = 'fail') as warned from c group by 1
""")  # fmt: skip
def eligibility_checks(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    rows = table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    known = lambda bad: F.when(F.col("n").isNull(), "unknown").when(bad, "fail").otherwise("pass")
    check = lambda rule, status, kind: F.struct(F.lit(rule).alias("rule"), status.alias("status"), F.lit(kind).alias("kind"))
    price = F.when(F.col("p_retailprice") > 1500, "fail").otherwise("pass")
    checks = F.array(check("demand", known(F.col("n") < 20), "requirement"), check("returns", known(F.col("returned") * 4 > F.col("n")), "requirement"), check("size", F.when(F.col("p_size") > 40, "partial").otherwise("pass"), "requirement"), check("price", price, "warning"))
    rows = rows.select(checks.alias("checks"), price.alias("price")).withColumn("status", R.eligibility(F.col("checks")))
    return rows.groupBy("status").agg(F.count("*").alias("parts"), F.sum((F.col("price") == "fail").cast("long")).alias("warned"))


@query("rank_with_margin", """
with s as (select s_nationkey, s_suppkey, round(0.5 * (s_acctbal + 1000) / 11000 + 0.3 * (s_suppkey % 10) / 10 + 0.2 * (s_suppkey % 3) / 3, 4) as score from supplier),
r as (select *, lead(score) over w as second, row_number() over w as k from s window w as (partition by s_nationkey order by score desc, s_suppkey))
select s_nationkey, s_suppkey, score, second, round(score - second, 4) as margin, round(least(0.9, 0.5 + (score - coalesce(second, 0.0))), 4) as confidence from r where k = 1
""")  # fmt: skip
def rank_with_margin(spark, d):
    from ..operators.sequences import winner

    score = F.round(0.5 * (F.col("s_acctbal") + 1000) / 11000 + 0.3 * (F.col("s_suppkey") % 10) / 10 + 0.2 * (F.col("s_suppkey") % 3) / 3, 4)
    out = winner(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", score.alias("score")), ["s_nationkey"], "score", ["s_suppkey"])
    return out.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.5 + (F.col("score") - F.coalesce("second", F.lit(0.0)))), 4))


@query("style_tags", r"""
with w as (select lower(text) as low, text, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')) as n from conversations),
t as (select list_filter([case when regexp_matches(low, '\b(kindly|please|would|request)\b') then 'formal' end, case when n <= 5 then 'short' end, case when n >= 25 then 'long' end,
  case when regexp_matches(low, '\b(urgent|immediately|asap|today)\b') then 'urgent' end, case when not regexp_matches(text, '[.!?]$') then 'no_punctuation' end, case when text = low then 'lowercase' end,
  case when regexp_matches(low, '\b(""" + "|".join(T.ABBREVIATIONS) + r""")\b') then 'abbreviated' end], lambda x: x is not null) as tags from w)
select coalesce(array_to_string(tags, ';'), '') as tags, count(*) as n from t group by 1
""")  # fmt: skip
def style_tags(spark, d):
    return table(spark, d, "conversations").groupBy(T.style_tags(F.col("text")).alias("tags")).agg(F.count("*").alias("n"))


@query("analyze_requests")
def analyze_requests(spark, d):
    """The request pipeline over all user turns: validation, routing, rejection, entities, evidence, answer, decision."""
    return analyze.analyze(
        table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text"),
        table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"),
        RULES,
    )


@query("error_categories", f"""
with {SCORED} select case when a_right and b_right then 'ok' when not a_right and not b_right then 'both_wrong' when a_right then 'second_wrong' when conf >= 0.75 then 'confident_error' else 'uncertain_error' end as category, count(*) as n from judged group by 1
""")  # fmt: skip
def error_categories(spark, d):
    a, b, c = F.col("a_right"), F.col("b_right"), F.col("conf")
    kind = F.when(a & b, "ok").when(~a & ~b, "both_wrong").when(a, "second_wrong").when(c >= 0.75, "confident_error").otherwise("uncertain_error")
    return judged(spark, d).groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@query("route_top_two", f"""
with n as (select doc_id, {COUNTS} from {ROUTED}), z as (select *, {" + ".join(f"exp(n_{k})" for k in RULES)} as z from n),
l as (select doc_id, unnest([{", ".join(f"'{k}'" for k in RULES)}]) as label, unnest([{", ".join(f"n_{k}" for k in RULES)}]) as score, unnest(range(0, {len(RULES)})) as i, z from z)
select doc_id, label, score, round(exp(score) / z, 6) as p, rank from (select *, row_number() over (partition by doc_id order by score desc, i) as rank from l) where rank <= 2
""")  # fmt: skip
def route_top_two(spark, d):
    """The two best labels of each document by keywords, within the row; equal scores go by the order of the rules."""
    rows = table(spark, d, "documents").select("doc_id", R.ranked_labels(F.col("text"), RULES, 2).alias("r"))
    return rows.select("doc_id", F.posexplode("r").alias("k", "x")).select("doc_id", "x.*", (F.col("k") + 1).cast("long").alias("rank"))


@query("current_orders", "select o_orderkey, o_orderstatus from orders where not (o_orderdate < timestamp '1993-01-01' and o_orderstatus = 'F')")
def current_orders(spark, d):
    """Rows that are not historical."""
    old = (F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp")) & (F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").where(~old).select("o_orderkey", "o_orderstatus")


@query("single_labels", "with t as (select user_id, string_agg(distinct event_type, '|' order by event_type) as kinds from events where value > 200 group by 1) select user_id as row_id, kinds as label from t where not contains(kinds, '|')")
def single_labels(spark, d):
    """Rows of one label, in the shape that models take."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds")
    rows = table(spark, d, "events").where("value > 200").groupBy("user_id").agg(kinds)
    return rows.where(~F.contains("kinds", F.lit("|"))).select(F.col("user_id").alias("row_id"), F.col("kinds").alias("label"))


@query("verified_rows", "select l.doc_id, quality from labels l join documents d on l.doc_id = d.doc_id where quality = 1 and not (toxic = 1) and not (lang <> 'en')")
def verified_rows(spark, d):
    """Rows that meet several conditions at once."""
    rows = table(spark, d, "labels").where((F.col("quality") == 1) & ~(F.col("toxic") == 1))
    return rows.join(table(spark, d, "documents").where(~(F.col("lang") != "en")).select("doc_id"), "doc_id").select("doc_id", "quality")


@query("answered_queries", "select conv_id, list_sort(list(distinct turn)) as relevant from conversations where role <> 'user' and length(text) > 80 group by 1 having count(*) > 0")
def answered_queries(spark, d):
    """Queries whose set of relevant rows is not empty."""
    relevant = F.array_sort(F.collect_set(F.when((F.col("role") != "user") & (F.length("text") > 80), F.col("turn")))).alias("relevant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(relevant).where(F.size("relevant") > 0)
