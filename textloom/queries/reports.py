"""Reports and derived tables: first and size, conditional fields, inverted maps, parsed rows, pools of failures, before and after."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import sequences as S
from ..plans import analyze
from ..registry import query
from ..session import small, table
from .classify import RULES, labelled_sql
from .metrics import SCORED, judged


@query("group_first_and_size", "select user_id, min_by(event_type, event_id) as first_type, count(*) as n from events group by 1")
def group_first_and_size(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.count("*").alias("n"))


@query("conditional_fields", """
select o_orderkey, case when o_orderstatus = 'F' then 'high' when o_orderstatus = 'O' then 'medium' else 'low' end as relevance, case when o_orderstatus = 'P' then 'not complete: ' || o_orderpriority else '' end as notes from orders
""")  # fmt: skip
def conditional_fields(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "high").when(s == "O", "medium").otherwise("low").alias("relevance"), F.when(s == "P", F.concat(F.lit("not complete: "), "o_orderpriority")).otherwise("").alias("notes"))


@query("inverted_taxonomy", """
with m as (select r_name, list(n_name order by n_name) as subs from nation join region on n_regionkey = r_regionkey group by 1)
select sub, r_name as parent from (select r_name, unnest(subs) as sub from m)
""")  # fmt: skip
def inverted_taxonomy(spark, d):
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    m = table(spark, d, "nation").join(small(regions), "n_regionkey").groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("subs"))
    return m.select(F.explode("subs").alias("sub"), F.col("r_name").alias("parent"))


@query("prefix_flags", "select p_partkey, starts_with(p_type, 'PROMO') as promo, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) as brand from part")
def prefix_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.startswith("p_type", F.lit("PROMO")).alias("promo"), F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lower(F.expr("substring(p_brand, 2)"))).alias("brand"))


@query("catalogue_rows", """
select n_name as programme, s_suppkey as number, s_name as course, s_suppkey % 4 as lecture, s_suppkey % 3 as practical, s_suppkey % 5 + 1 as credits, case when s_suppkey % 7 = 0 then 'slot' else 'course' end as kind from supplier join nation on s_nationkey = n_nationkey
""")  # fmt: skip
def catalogue_rows(spark, d):
    """A catalogue as lines, parsed back: a header holds until the next one, rows are cut by a pattern."""
    nations, suppliers = table(spark, d, "nation"), table(spark, d, "supplier")
    head = nations.select(F.col("n_nationkey").cast("long").alias("g"), F.lit(-1).cast("long").alias("k"), F.concat(F.lit("Programme: "), "n_name").alias("line"))
    k = F.col("s_suppkey")
    row = suppliers.select(F.col("s_nationkey").cast("long").alias("g"), k.alias("k"), F.format_string("%d. %s %d-%d-0 %d%s", k, F.col("s_name"), k % 4, k % 3, k % 5 + 1, F.when(k % 7 == 0, " (select one)").otherwise("")).alias("line"))
    header = F.regexp_extract("line", "^Programme: (.+)$", 1)
    lines = head.unionByName(row).withColumn("head", F.when(header != "", header))
    # headers hold within a section here, so the window is by section and never over the whole catalogue
    lines = S.forward_fill(lines, ["g"], ["k"], {"head": "programme"}).where("head is null")
    part = lambda i: F.regexp_extract("line", r"^(\d+)\. (.+) (\d+)-(\d+)-\d+ (\d+)( \(select one\))?$", i)
    return lines.select("programme", part(1).cast("long").alias("number"), part(2).alias("course"), part(3).cast("long").alias("lecture"), part(4).cast("long").alias("practical"), part(5).cast("long").alias("credits"), F.when(part(6) != "", "slot").otherwise("course").alias("kind"))


@query("binary_decision", f"""
with {SCORED} select count(*) filter (score >= 0.7) as predicted, count(*) filter (gold = 0) as wanted, round(count(*) filter (score < 0.3 and gold = 0) / nullif(count(*) filter (score < 0.3), 0), 6) as precision, round(count(*) filter (score < 0.3 and gold = 0) / nullif(count(*) filter (gold = 0), 0), 6) as recall from judged
""")  # fmt: skip
def binary_decision(spark, d):
    n = lambda c: F.sum(c.cast("long"))
    low, bad = F.col("score") < 0.3, F.col("gold") == 0
    ratio = lambda a, b: F.round(n(a) / F.nullif(n(b), F.lit(0)), 6)
    return judged(spark, d).agg(n(F.col("score") >= 0.7).alias("predicted"), n(bad).alias("wanted"), ratio(low & bad, low).alias("precision"), ratio(low & bad, bad).alias("recall"))


@query("before_after", f"""
with {SCORED}, s as (select case when gold = 1 then 'good' else 'bad' end as slice, avg(cast(a_right as double)) as a, avg(cast(b_right as double)) as b, count(*) as n from judged group by 1)
select slice, n, round(b, 6) as before, round(a, 6) as after, round(a - b, 6) as delta from s
""")  # fmt: skip
def before_after(spark, d):
    mean = lambda c: F.avg(F.col(c).cast("double"))
    s = judged(spark, d).groupBy(F.when(F.col("gold") == 1, "good").otherwise("bad").alias("slice")).agg(F.count("*").alias("n"), mean("a_right").alias("a"), mean("b_right").alias("b"))
    return s.select("slice", "n", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("set_inventory", """
with s as (select case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'validation' else 'test' end as part, lang, source from documents),
l as (select part, lang, count(*) as n from s group by all)
select s.part, count(*) as n, count(distinct source) as sources, (select string_agg(lang || '=' || cast(l.n as varchar), ';' order by lang) from l where l.part = s.part) as langs from s group by s.part
""")  # fmt: skip
def set_inventory(spark, d):
    m = F.col("doc_id") % 10
    s = table(spark, d, "documents").select(F.when(m < 7, "train").when(m < 9, "validation").otherwise("test").alias("part"), "lang", "source")
    langs = s.groupBy("part", "lang").agg(F.count("*").alias("n"))
    langs = langs.groupBy("part").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", F.col("n").cast("string")))), ";").alias("langs"))
    return langs.join(s.groupBy("part").agg(F.count_distinct("source").alias("sources")), "part")


@query("failure_pools", f"""
with {SCORED}, c as (select doc_id, conf, case when not a_right and not b_right then 'both' when not a_right then 'first' else 'second' end as category from judged where not (a_right and b_right)),
r as (select *, row_number() over (partition by category order by conf desc, doc_id) as rank from c)
select category, doc_id, conf, rank from r where rank <= 6
""")  # fmt: skip
def failure_pools(spark, d):
    a, b = F.col("a_right"), F.col("b_right")
    c = judged(spark, d).where(~(a & b)).select("doc_id", "conf", F.when(~a & ~b, "both").when(~a, "first").otherwise("second").alias("category"))
    w = Window.partitionBy("category").orderBy(F.desc("conf"), "doc_id")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 6")


@query("component_info", f"""
with k as (select unnest(['article', 'german', 'spanish', 'french', 'out_of_scope']) as label, unnest([2, 3, 3, 3, 0]) as keywords), r as (select {labelled_sql("text")} as label, count(*) as n from documents group by 1)
select label, keywords, coalesce(n, 0) as documents, '1.0' as schema_version from k left join r using (label)
""")  # fmt: skip
def component_info(spark, d):
    """What the router knows of each label, and how many documents it sends there."""
    rows = spark.createDataFrame([(k, len(v)) for k, v in RULES.items()] + [(R.OUT, 0)], "label string, keywords int")
    sent = table(spark, d, "documents").select(R.route(F.col("text"), RULES)["label"].alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    out = rows.join(sent, "label", "left").select("label", "keywords", F.coalesce("n", F.lit(0)).alias("documents"))
    return out.withColumn("schema_version", F.lit(analyze.SCHEMA_VERSION))


@query("response_rows")
def response_rows(spark, d):
    """Responses flattened for evaluation, with the size of each as JSON."""
    from .classify import analyze_requests

    r = analyze_requests(spark, d)
    size = F.octet_length(F.to_json(F.struct(*r.columns))).cast("long")
    return r.select("request_id", "label", "level", "action", F.size("sources").alias("n_sources"), F.get("sources", F.lit(0))["doc_id"].alias("best"), F.size("entities").alias("n_entities"), size.alias("bytes"))


CUES = {"age": "I am 45. ", "gender": "As a woman, ", "place": "I live in a village. ", "health": "I use a wheelchair. "}


@query("invariance_rate", f"""
with c as (select unnest([{", ".join(f"'{k}'" for k in CUES)}]) as cue, unnest([{", ".join(f"'{v}'" for v in CUES.values())}]) as said)
select cue, count(*) as n, round(avg(cast(({labelled_sql("text")}) = ({labelled_sql("said || text")}) as double)), 6) as unchanged from conversations, c where role = 'user' group by cue
""")  # fmt: skip
def invariance_rate(spark, d):
    """How often personal cues leave the routing label as it was: each request once with each cue."""
    cues = F.array(*[F.struct(F.lit(k).alias("cue"), F.lit(v).alias("said")) for k, v in CUES.items()])
    rows = table(spark, d, "conversations").where("role = 'user'").select("text", R.route(F.col("text"), RULES)["label"].alias("label"))
    rows = rows.select("text", "label", F.explode(cues).alias("c"))
    rows = rows.select("label", "c.cue", R.route(F.concat("c.said", "text"), RULES)["label"].alias("now"))
    return rows.groupBy("cue").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("now")).cast("double")), 6).alias("unchanged"))
