"""Assessments, profiles, scores by type and by sequence, spellings and parts of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assess as A
from ..operators import entities as E
from ..operators import metrics as M
from ..operators import parsing as P
from ..operators.sequences import bio_decode
from ..registry import query
from ..session import digest_int, small, table
from .documents import sheets
from .entities import SPANS, spans

# seven checks of a part by what was sold of it

ASSESSED = """
sold as (select l_partkey, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as returned, count(distinct l_suppkey) as suppliers, max(l_discount) as discount, min(l_shipdate) as since from lineitem group by 1),
rows as (select p_partkey, p_name, p_size, p_retailprice, n, returned, suppliers, discount, since from part left join sold on p_partkey = l_partkey),
checks as (
  select p_partkey, 'demand' as rule, 'requirement' as kind, case when n is null then 'unknown' when n < 20 then 'fail' when n < 30 then 'partial' else 'pass' end as status, cast(n as varchar) as cites from rows
  union all select p_partkey, 'returns', 'requirement', case when returned is null then 'unknown' when returned * 4 > n then 'fail' else 'pass' end, cast(returned as varchar) from rows
  union all select p_partkey, 'suppliers', 'requirement', case when suppliers is null then 'unknown' when suppliers < 2 then 'fail' else 'pass' end, cast(suppliers as varchar) from rows
  union all select p_partkey, 'size', 'requirement', case when p_size > 45 then 'fail' when p_size > 40 then 'partial' else 'pass' end, cast(p_size as varchar) from rows
  union all select p_partkey, 'price', 'warning', case when p_retailprice > 1500 then 'fail' else 'pass' end, p_name from rows
  union all select p_partkey, 'discount', 'warning', case when discount is null then 'unknown' when discount > 0.09 then 'fail' else 'pass' end, cast(n as varchar) from rows
  union all select p_partkey, 'known_since', 'information', case when since is null then 'unknown' when since >= timestamp '1995-01-01' then 'fail' else 'pass' end, strftime(since, '%Y-%m-%d') from rows
)"""


def assessed(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_discount").alias("discount"), F.min("l_shipdate").alias("since")
    )
    rows = table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    c, n = F.col, F.col("n")
    checks = F.array(
        A.check("demand", "requirement", n < 20, n, partial=n < 30),
        A.check("returns", "requirement", c("returned") * 4 > n, c("returned")),
        A.check("suppliers", "requirement", c("suppliers") < 2, c("suppliers")),
        A.check("size", "requirement", c("p_size") > 45, c("p_size"), partial=c("p_size") > 40),
        A.check("price", "warning", c("p_retailprice") > 1500, c("p_name")),
        A.check("discount", "warning", c("discount") > 0.09, n),
        A.check("known_since", "information", c("since") >= F.lit("1995-01-01").cast("timestamp"), F.date_format("since", "yyyy-MM-dd")),
    )
    return rows.select("p_partkey", checks.alias("checks"))


@query("assessment_checks", f"with {ASSESSED} select * from checks")
def assessment_checks(spark, d):
    return assessed(spark, d).select("p_partkey", F.explode("checks").alias("c")).select("p_partkey", "c.*")


@query("assessment_report", f"with {ASSESSED} select rule, kind, status, count(*) as n, count(cites) as cited, round(count(*) / sum(count(*)) over (partition by rule), 6) as share from checks group by rule, kind, status")
def assessment_report(spark, d):
    return A.report(assessed(spark, d))


@query("assessment_status", f"""
with {ASSESSED}, s as (select p_partkey, max(case when kind = 'requirement' and status = 'fail' then 3 when kind = 'requirement' and status = 'unknown' then 2 when kind = 'requirement' and status = 'partial' then 1 else 0 end) as worst,
  count(*) filter (kind = 'warning' and status = 'fail') as warnings, string_agg(case when status = 'fail' then rule end, '|' order by rule) as failed from checks group by 1)
select p_partkey, ['eligible', 'conditional', 'needs_review', 'not_eligible'][worst + 1] as status, warnings, coalesce(failed, '') as failed from s
""")  # fmt: skip
def assessment_status(spark, d):
    from ..operators.routing import eligibility

    has = lambda s, k: F.size(F.filter("checks", lambda c: (c["status"] == s) & (c["kind"] == k))).cast("long")
    failed = F.array_sort(F.transform(F.filter("checks", lambda c: c["status"] == "fail"), lambda c: c["rule"]))
    return assessed(spark, d).select("p_partkey", eligibility(F.col("checks")).alias("status"), has("fail", "warning").alias("warnings"), F.array_join(failed, "|").alias("failed"))


@query("customer_profile", """
with o as (select o_custkey, count(*) as orders, mode(o_orderpriority) as m, max(o_orderpriority) as urgent from orders group by 1),
r as (select c_custkey, case when c_custkey % 7 <> 0 then c_mktsegment end as segment, case when c_custkey % 5 <> 0 then c_nationkey end as nation, urgent as priority, orders from customer left join o on c_custkey = o_custkey)
select c_custkey, coalesce(segment, 'GENERAL') as segment, nation, coalesce(priority, case when nation < 5 then '5-LOW' end) as priority, orders,
  concat_ws('|', case when segment is null then 'segment' end, case when priority is null and nation < 5 then 'priority' end) as inferred,
  round((case when segment is not null then 1.0 else 0.5 end + case when nation is not null then 1.0 else 0.0 end + case when priority is not null then 1.0 when nation < 5 then 0.5 else 0.0 end + case when orders is not null then 1.0 else 0.0 end) / 4, 4) as confidence from r
""")  # fmt: skip
def customer_profile(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderpriority").alias("urgent"))
    rows = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    nation = F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey"))
    fields = {"segment": F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")), "nation": nation, "priority": F.col("urgent"), "orders": F.col("orders")}
    return A.profile(rows, "c_custkey", fields, {"segment": F.lit("GENERAL"), "priority": F.when(nation < 5, F.lit("5-LOW"))})


@query("partner_advice", """
with f as (select s_nationkey, s_suppkey, s_acctbal > 0 as ok, round(s_acctbal / 11000 + (s_suppkey % 10) / 20.0, 6) as score from supplier),
b as (select s_nationkey, cast(sum(case when ok then 0 else 1 end) as bigint) as rejected, count(*) as received from f group by 1),
n as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as k from f where ok),
r as (select *, row_number() over (partition by s_nationkey order by score desc, s_suppkey) as r from n where k <= 20)
select b.s_nationkey, rejected, received, s_suppkey, score from b left join r on b.s_nationkey = r.s_nationkey and r.r = 1
""")  # fmt: skip
def partner_advice(spark, d):
    return A.advise(table(spark, d, "supplier"), "s_nationkey", ["s_suppkey"], F.col("s_acctbal") > 0, F.col("s_acctbal") / 11000 + (F.col("s_suppkey") % 10) / 20.0)


# scores by type and of sequences

@query("span_scores_by_type", f"""
with {SPANS}, p as (select distinct doc_id, s, e, label from pred), g as (select distinct doc_id, s, e, label from gold),
rows as (
  select p.label, 1 as p, 0 as g, (exists (select 1 from g where g.doc_id = p.doc_id and g.s = p.s and g.e = p.e and g.label = p.label))::int as xp, 0 as xg, (exists (select 1 from g where g.doc_id = p.doc_id and g.label = p.label and g.s < p.e and p.s < g.e))::int as np, 0 as ng from p
  union all select g.label, 0, 1, 0, (exists (select 1 from p where g.doc_id = p.doc_id and g.s = p.s and g.e = p.e and g.label = p.label))::int, 0, (exists (select 1 from p where g.doc_id = p.doc_id and g.label = p.label and g.s < p.e and p.s < g.e))::int from g),
n as (select coalesce(label, 'ALL') as label, cast(sum(p) as bigint) as predicted, cast(sum(g) as bigint) as gold, sum(xp) / greatest(sum(p), 1) as a, sum(xg) / greatest(sum(g), 1) as b, sum(np) / greatest(sum(p), 1) as x, sum(ng) / greatest(sum(g), 1) as y from rows group by rollup (label))
select label, predicted, gold, round(a, 6) as precision, round(b, 6) as recall, round(case when a + b > 0 then 2 * a * b / (a + b) else 0 end, 6) as f1,
  round(x, 6) as relaxed_precision, round(y, 6) as relaxed_recall, round(case when x + y > 0 then 2 * x * y / (x + y) else 0 end, 6) as relaxed_f1 from n
""")  # fmt: skip
def span_scores_by_type(spark, d):
    return E.span_scores_by_type(spans(spark, d, True), spans(spark, d, False))


TAGGED = """
t as (select o_orderkey, pos, ['O', 'B-ITEM', 'I-ITEM', 'B-DAY'][(o_orderkey + pos * pos) % 4 + 1] as gold, case when (o_orderkey + pos) % 13 <> 0 then 0.5 + ((o_orderkey + pos) % 5) / 10.0 end as p from orders, (select unnest(range(0, 6)) as pos)),
t2 as (select *, case when (o_orderkey * 3 + pos) % 11 = 0 then 'O' when (o_orderkey + pos) % 17 = 0 then 'I-DAY' else gold end as pred from t),
sides as (select o_orderkey, pos, p, 'gold' as side, gold as tag from t2 union all select o_orderkey, pos, p, 'pred', pred from t2),
m as (select *, substr(tag, 3) as label, lag(substr(tag, 3), 1, '') over (partition by o_orderkey, side order by pos) as before from sides),
f as (select *, sum(case when tag like 'B-%' or label <> before then 1 else 0 end) over (partition by o_orderkey, side order by pos rows unbounded preceding) as k from m),
ent as (select o_orderkey, side, label, min(pos) as a, max(pos) as z, case when count(p) = count(*) then round(avg(p), 4) end as confidence from f where label <> '' group by o_orderkey, side, k, label)
"""


def tagged(spark, d):
    pos = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos")
    rows = table(spark, d, "orders").select("o_orderkey", pos)
    k = F.col("o_orderkey") + F.col("pos")
    tags = F.array(*map(F.lit, ("O", "B-ITEM", "I-ITEM", "B-DAY")))
    rows = rows.withColumn("gold", F.element_at(tags, ((F.col("o_orderkey") + F.col("pos") * F.col("pos")) % 4 + 1).cast("int")))
    pred = F.when((F.col("o_orderkey") * 3 + F.col("pos")) % 11 == 0, "O").when(k % 17 == 0, "I-DAY").otherwise(F.col("gold"))
    return rows.withColumns({"pred": pred, "p": F.when(k % 13 != 0, 0.5 + (k % 5) / 10.0)})


@query("sequence_scores", f"""
with {TAGGED}, j as (select coalesce(p.label, g.label) as label, p.label as p, g.label as g from (select * from ent where side = 'pred') p full join (select * from ent where side = 'gold') g on p.o_orderkey = g.o_orderkey and p.label = g.label and p.a = g.a and p.z = g.z),
n as (select coalesce(label, 'ALL') as label, count(p) as predicted, count(g) as gold, count(*) filter (p is not null and g is not null) as correct from j group by rollup (label)),
r as (select *, correct / greatest(predicted, 1) as a, correct / greatest(gold, 1) as b from n)
select label, predicted, gold, correct, round(a, 6) as precision, round(b, 6) as recall, round(case when a + b > 0 then 2 * a * b / (a + b) else 0 end, 6) as f1 from r
""")  # fmt: skip
def sequence_scores(spark, d):
    return E.sequence_scores(tagged(spark, d), ["o_orderkey"])


@query("entity_confidence", f"with {TAGGED} select label, cast(z - a + 1 as int) as tokens, confidence, count(*) as n from ent where side = 'pred' group by all")
def entity_confidence(spark, d):
    found = bio_decode(tagged(spark, d), ["o_orderkey"], "pos", "pred", "p")
    return found.groupBy("label", (F.col("last") - F.col("first") + 1).alias("tokens"), "confidence").agg(F.count("*").alias("n"))


@query("gold_rank", "with r as (select l_orderkey, l_linenumber, rank() over (partition by l_orderkey order by l_quantity desc) as rank from lineitem) select rank, count(*) as n from r where l_linenumber = 1 group by 1")
def gold_rank(spark, d):
    """Rank of one row of each group by value; equal values share the better rank."""
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").withColumn("rank", F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))).cast("long"))
    return rows.where("l_linenumber = 1").groupBy("rank").agg(F.count("*").alias("n"))


@query("scores_by_split", """
with s as (select l.doc_id, quality as gold, case when n_chars > 1000 then 1 else 0 end as pred, case when cast('0x' || substr(md5(cast(l.doc_id as varchar) || '|split'), 1, 8) as bigint) % 10 < 7 then 'train' else 'test' end as split from labels l join documents d on l.doc_id = d.doc_id),
c as (select split, label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
  select split, gold as label, (gold = pred)::int as tp, 0 as fp, (gold <> pred)::int as fn from s union all select split, pred, 0, (gold <> pred)::int, 0 from s) group by all)
select split, cast(sum(tp + fn) as bigint) as n, round(sum(tp) / sum(tp + fn), 6) as accuracy, round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 6) as macro_f1 from c group by split
""")  # fmt: skip
def scores_by_split(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    split = F.when(digest_int(F.col("doc_id").cast("string"), F.lit("split")) % 10 < 7, "train").otherwise("test")
    return M.macro(rows.select(split.alias("split"), F.col("quality").alias("gold"), (F.col("n_chars") > 1000).cast("int").alias("pred")), by=("split",))


# spellings, names and parts of texts

@query("identity_keys", """
select trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_brand || ' & ' || p_type || '-' || p_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\\b(economy|standard)\\b', 'plain', 'g'), ' +', ' ', 'g')) as key, count(*) as n from part group by 1
""")  # fmt: skip
def identity_keys(spark, d):
    said = F.concat("p_brand", F.lit(" & "), "p_type", F.lit("-"), "p_name")
    return table(spark, d, "part").groupBy(T.identity_key(said, {"economy|standard": "plain"}).alias("key")).agg(F.count("*").alias("n"))


@query("course_rules", """
with t as (select p_partkey, p_type, p_name || case when p_size % 5 = 0 then ' (New)' when p_size % 7 = 0 then '*' else '' end as said from part),
w as (select *, trim(regexp_replace(regexp_replace(said, '(?i)\\(new\\)|[*]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as name from t)
select p_partkey, case when regexp_matches(lower(p_type), 'promo|economy') then 'elective' when regexp_matches(lower(p_type), 'standard|small|medium') then 'core' else 'other' end as course_type,
  array_to_string(list_transform(string_split(lower(name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title, regexp_matches(said, '(?i)\\(new\\)|[*]') as is_new from w
""")  # fmt: skip
def course_rules(spark, d):
    said = F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " (New)").when(F.col("p_size") % 7 == 0, "*").otherwise(""))
    kind = T.first_match(F.lower("p_type"), [("promo|economy", "elective"), ("standard|small|medium", "core")], "other")
    return table(spark, d, "part").select("p_partkey", kind.alias("course_type"), T.title(said).alias("title"), T.is_new(said).alias("is_new"))


@query("sheets_as_prose", """
select p_partkey, 'The course is ' || p_name || '. The course type is ' || p_type || '. The semester is ' || (p_size % 8 + 1) || '. The credits is ' || (p_size % 4 + 1) || '. The objective is to know more. The course is a second name.' as prose from part
""")  # fmt: skip
def sheets_as_prose(spark, d):
    return sheets(spark, d).select("p_partkey", T.to_prose(F.col("text")).alias("prose"))


@query("canonical_spellings", """
with t as (select s_suppkey, string_split(lower('from ' || n_name || ' to china by sea'), ' ') as w from supplier join nation on s_nationkey = n_nationkey),
x as (select s_suppkey, i, w[i] as token from (select s_suppkey, w, unnest(range(1, len(w) + 1)) as i from t))
select s_suppkey, string_agg(coalesce(n_name, upper(token[1]) || token[2:]), ' ' order by i) as said from x left join nation on lower(n_name) = token group by 1
""")  # fmt: skip
def canonical_spellings(spark, d):
    nation = table(spark, d, "nation")
    said = table(spark, d, "supplier").join(small(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    tokens = said.select("s_suppkey", F.posexplode(F.split(F.lower(F.concat(F.lit("from "), "n_name", F.lit(" to china by sea"))), " ")).alias("pos", "token"))
    rows = P.canonical(tokens, nation, name="n_name")
    return rows.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical"))), lambda x: x["canonical"]), " ").alias("said"))


@query("field_accuracy", """
with t as (select p_partkey, p_name, p_type, 'Course: ' || p_name || chr(10) || 'Course Type: ' || p_type || chr(10) || 'Semester: ' || (p_size % 8 + 1) as said from part),
v as (select 'as_is' as transform, p_name, p_type, said from t union all select 'upper', p_name, p_type, upper(said) from t union all select 'no_colons', p_name, p_type, replace(said, ':', '') from t union all select 'indented', p_name, p_type, regexp_replace(said, '(?m)^', '  ', 'g') from t),
f as (select transform, 'course' as field, lower(p_name) as gold, lower(trim(regexp_extract(said, '(?im)^[ \\t]*Course[ \\t]*[:\\-][ \\t]*(.+?)[ \\t]*$', 1))) as got from v
  union all select transform, 'course_type', lower(p_type), lower(trim(regexp_extract(said, '(?im)^[ \\t]*Course Type[ \\t]*[:\\-][ \\t]*(.+?)[ \\t]*$', 1))) from v)
select transform, field, count(*) as n, round(avg((gold = got)::int), 6) as accuracy from f group by all
""")  # fmt: skip
def field_accuracy(spark, d):
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    said = F.concat_ws("\n", line("Course", F.col("p_name")), line("Course Type", F.col("p_type")), line("Semester", (F.col("p_size") % 8 + 1).cast("string")))
    changes = {"as_is": lambda t: t, "upper": F.upper, "no_colons": lambda t: F.replace(t, F.lit(":"), F.lit("")), "indented": lambda t: F.regexp_replace(t, "(?m)^", "  ")}
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type", said.alias("text"))
    return P.field_accuracy(rows, "p_partkey", "text", {"course": "p_name", "course_type": "p_type"}, {"course": "Course", "course_type": "Course Type"}, changes)


@query("page_chunks", """
with d as (select doc_id, case when doc_id % 3 = 0 then replace(text, chr(10), ' [page] ') else text end as t from documents),
p as (select doc_id, unnest(list_transform(string_split(t, '[page]'), lambda x: list_filter(regexp_split_to_array(x, '[ \\t\\r\\n]+'), lambda y: y <> ''))) as w, generate_subscripts(string_split(t, '[page]'), 1) - 1 as part from d where contains(t, '[page]')),
w as (select doc_id, list_filter(regexp_split_to_array(coalesce(t, ''), '[ \\t\\r\\n]+'), lambda y: y <> '') as w from d where not coalesce(contains(t, '[page]'), false)),
c as (select doc_id, w[k + 1 : k + 220] as w, k // 200 as part from (select doc_id, w, unnest(range(0, len(w), 200)) as k from w)),
a as (select doc_id, part, w from p union all select doc_id, part, w from c)
select doc_id, cast(part as int) as part, cast(len(w) as int) as n_words, md5(array_to_string(w, ' ')) as digest from a where len(w) >= 30
""")  # fmt: skip
def page_chunks(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit(" [page] "))).otherwise(F.col("text"))
    rows = P.page_chunks(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text", r"\[page\]")
    return rows.select("doc_id", "part", "n_words", F.md5("chunk").alias("digest"))


@query("fact_documents", """
with facts as (select distinct l_partkey as fact, l_suppkey as doc from lineitem where l_returnflag = 'R' and l_quantity > 45),
asked as (select distinct l_orderkey as query_id, l_partkey as fact from lineitem where l_quantity > 40)
select query_id, count(distinct doc) as docs, string_agg(distinct cast(doc as varchar), '|' order by cast(doc as varchar)) as found from asked join facts using (fact) group by 1
""")  # fmt: skip
def fact_documents(spark, d):
    """The documents of all facts that a query asks for, by an inverted index from facts to documents."""
    lines = table(spark, d, "lineitem")
    index = lines.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("fact"), F.col("l_suppkey").cast("string").alias("doc")).distinct()
    asked = lines.where("l_quantity > 40").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("fact")).distinct()
    found = asked.join(index, "fact").groupBy("query_id").agg(F.array_sort(F.collect_set("doc")).alias("d"))
    return found.select("query_id", F.size("d").cast("long").alias("docs"), F.array_join("d", "|").alias("found"))


@query("other_domain_rows", """
with r as (select role as domain, conv_id, turn, cast('0x' || substr(md5(cast(conv_id as varchar) || '|' || cast(turn as varchar) || '|ood'), 1, 8) as bigint) as h from conversations where trim(text) <> ''),
s as (select *, case when h % 100 < 70 then 'train' when h % 100 < 85 then 'validation' else 'test' end as split from r),
k as (select *, row_number() over (partition by domain, split order by h, conv_id, turn) as n from s)
select domain, split, conv_id, turn, 'out_of_scope' as label from k where n <= 40
""")  # fmt: skip
def other_domain_rows(spark, d):
    """Rows of other domains as one class: splits by digest, and a sample of forty a domain and split, those with the least digests."""
    from pyspark.sql import Window

    h = digest_int(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("ood"))
    rows = table(spark, d, "conversations").where(F.trim("text") != "").select(F.col("role").alias("domain"), "conv_id", "turn", h.alias("h"))
    rows = rows.withColumn("split", F.when(F.col("h") % 100 < 70, "train").when(F.col("h") % 100 < 85, "validation").otherwise("test"))
    w = Window.partitionBy("domain", "split").orderBy("h", "conv_id", "turn")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 40").select("domain", "split", "conv_id", "turn", F.lit("out_of_scope").alias("label"))


@query("char_ngram_weights", """
with w as (select conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from conversations),
p as (select conv_id, ' ' || w || ' ' as w from w),
g as (select conv_id, w[i : i + n - 1] as gram from (select conv_id, w, n, unnest(range(1, len(w) - n + 2)) as i from p, (select unnest(range(2, 6)) as n) where len(w) >= n)),
c as (select conv_id, gram, count(*) as tf from g group by all),
d as (select gram, count(*) as df from c group by 1), n as (select count(distinct conv_id) as n from c)
select gram, df, round(sum(1 + ln(tf)), 6) as sublinear, round(ln((1 + n) / (1 + df)) + 1, 6) as idf from c join d using (gram), n group by gram, df, n
""")  # fmt: skip
def char_ngram_weights(spark, d):
    """Character 2- to 5-grams within words: document frequency, summed sublinear counts, smoothed idf."""
    rows = table(spark, d, "conversations").select("conv_id", F.explode(T.tokens(F.col("text"), "[a-z]+")).alias("w")).select("conv_id", F.explode(T.char_ngrams(F.col("w"))).alias("gram"))
    c = rows.groupBy("conv_id", "gram").agg(F.count("*").alias("tf"))
    n = c.agg(F.count_distinct("conv_id")).first()[0]
    by = c.groupBy("gram").agg(F.count("*").alias("df"), F.round(F.sum(1 + F.log("tf")), 6).alias("sublinear"))
    return by.withColumn("idf", F.round(F.log((1 + n) / (1 + F.col("df"))) + 1, 6))
