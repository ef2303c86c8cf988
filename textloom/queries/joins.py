"""Joins and group lookups over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..registry import query
from ..session import small, table


@query("dimension_lookup", """
select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all
""")  # fmt: skip
def dimension_lookup(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    nations = J.strict(nations, table(spark, d, "region"), "r_regionkey", "region").withColumnRenamed("n_nationkey", "c_nationkey")
    by = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    rows = J.strict(by, nations, "c_nationkey", "nation")
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query("multi_value_lookup", """
with keys as (select o_custkey, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as ids from orders group by o_custkey),
parts as (select o_custkey, unnest(string_split(ids, '|')) as k, generate_subscripts(string_split(ids, '|'), 1) as pos from keys),
dim as (select o_orderpriority as k, cast(count(*) as varchar) as v from orders group by 1)
select o_custkey, string_agg(v, ' || ' order by pos) as counts from parts join dim using (k) group by o_custkey
""")  # fmt: skip
def multi_value_lookup(spark, d):
    orders = table(spark, d, "orders")
    keys = orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("ids"))
    dim = orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").cast("string").alias("v"))
    out = J.multi_lookup(keys, F.split("ids", "[|]"), dim, "k", "v", "o_custkey", "counts")
    return out.withColumn("counts", F.array_join("counts", " || "))


@query("composite_left_join", """
select p_brand, p_type, count(*) as parts, cast(count(l_partkey) as bigint) as sold, round(coalesce(sum(q), 0), 2) as quantity
from part left join (select l_partkey, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1) on p_partkey = l_partkey group by all
""")  # fmt: skip
def composite_left_join(spark, d):
    sold = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    rows = table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"), F.count("l_partkey").alias("sold"), F.round(F.coalesce(F.sum("q"), F.lit(0)), 2).alias("quantity"))


@query("any_overlap_semi_join", """
select distinct a.l_orderkey as order_key from lineitem a join (select distinct l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45) b using (l_partkey)
""")  # fmt: skip
def any_overlap_semi_join(spark, d):
    lines = table(spark, d, "lineitem")
    wanted = lines.where("l_returnflag = 'R' and l_quantity > 45").select("l_partkey")
    return lines.join(wanted, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("order_key")).distinct()


@query("unknown_references", "select distinct o_custkey as missing from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def unknown_references(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("missing"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("missing")).join(known, "missing", "left_anti").distinct()


@query("mode_first_seen", """
with c as (select user_id, event_type, count(*) as n, min(event_id) as first_at from events group by all),
r as (select *, row_number() over (partition by user_id order by n desc, first_at) as k from c)
select user_id, event_type from r where k = 1
""")  # fmt: skip
def mode_first_seen(spark, d):
    return J.first_seen_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("ordered_distinct", """
with f as (select conv_id, role, min(turn) as first_at from conversations group by all)
select conv_id, string_agg(role, '|' order by first_at, role) as roles from f group by conv_id
""")  # fmt: skip
def ordered_distinct(spark, d):
    out = J.ordered_distinct(table(spark, d, "conversations"), ["conv_id"], "role", "turn", "roles")
    return out.withColumn("roles", F.array_join("roles", "|"))


@query("lexicon_mode_by_dim", """
with o as (select n_name, o_orderpriority, count(*) as n, min(o_orderkey) as first_at from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
m as (select *, row_number() over (partition by n_name order by n desc, first_at) as r from o)
select n_name, max(o_orderpriority) filter (r = 1) as department, string_agg(o_orderpriority, ' / ' order by first_at) as documents, cast(sum(n) as bigint) as facts from m group by n_name
""")  # fmt: skip
def lexicon_mode_by_dim(spark, d):
    who = table(spark, d, "customer").join(small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "o_orderpriority", "o_orderkey")
    mode = J.first_seen_mode(rows, ["n_name"], "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "department")
    docs = J.ordered_distinct(rows, ["n_name"], "o_orderpriority", "o_orderkey", "documents").withColumn("documents", F.array_join("documents", " / "))
    return mode.join(docs, "n_name").join(rows.groupBy("n_name").agg(F.count("*").alias("facts")), "n_name")


@query("probability_blend", """
with a as (select doc_id as row_id, unnest(['x', 'y']) as label, unnest([0.25, 0.75]) as p from documents),
b as (select doc_id as row_id, unnest(['y', 'z']) as label, unnest([0.5, 0.5]) as p from documents where lang = 'en')
select row_id, label, round(sum(p) / 3.0, 6) as p from (select row_id, label, p * 1.0 as p from a union all select row_id, label, p * 2.0 from b) group by all
""")  # fmt: skip
def probability_blend(spark, d):
    docs = table(spark, d, "documents")
    long = lambda df, *kv: df.select(F.col("doc_id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("p")) for k, v in kv])).alias("x")).select("row_id", "x.*")
    return J.blend([(long(docs, ("x", 0.25), ("y", 0.75)), 1.0), (long(docs.where("lang = 'en'"), ("y", 0.5), ("z", 0.5)), 2.0)])


@query("label_roll_up", """
select row_id, coalesce(parent, 'out_of_scope') as parent, round(sum(p), 6) as p
from (select vec_id as row_id, unnest(['a1', 'a2', 'b1', 'zz']) as label, unnest([0.3, 0.3, 0.35, 0.05]) as p from embeddings) left join (select unnest(['a1', 'a2', 'b1']) as label, unnest(['a', 'a', 'b']) as parent) using (label) group by all
""")  # fmt: skip
def label_roll_up(spark, d):
    probs = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.explode(F.create_map(*[F.lit(x) for x in ("a1", 0.3, "a2", 0.3, "b1", 0.35, "zz", 0.05)])).alias("label", "p"))
    parents = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "label string, parent string")
    return J.roll_up(probs, parents)


@query("jaccard_sets", """
with s as (select l_suppkey, list_distinct(list(l_returnflag || l_linestatus || cast(month(l_shipdate) as varchar))) as a from lineitem group by 1),
t as (select l_suppkey, list_distinct(list(l_returnflag || l_linestatus || cast(month(l_shipdate) as varchar))) as b from lineitem where l_quantity >= 40 group by 1)
select l_suppkey, round(case when len(list_distinct(list_concat(a, coalesce(b, [])))) = 0 then 1.0 else len(list_intersect(a, coalesce(b, []))) / len(list_distinct(list_concat(a, coalesce(b, [])))) end, 6) as jaccard
from s left join t using (l_suppkey)
""")  # fmt: skip
def jaccard_sets(spark, d):
    from ..functions.text import jaccard

    lines = table(spark, d, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus", F.month("l_shipdate").cast("string")))
    rows = lines.groupBy("l_suppkey").agg(F.collect_set("k").alias("a"), F.collect_set(F.when(F.col("l_quantity") >= 40, F.col("k"))).alias("b"))
    return rows.select("l_suppkey", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("keep_first_by_key", """
with r as (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as k from orders)
select o_custkey, o_orderstatus, o_orderdate, o_orderkey, o_totalprice from r where k = 1
""")  # fmt: skip
def keep_first_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    return J.keep_first(orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])


@query("left_defaults_join", """
select s_suppkey, s_name, coalesce(n, 0) as late, coalesce(worst, 'none') as worst from supplier left join
(select l_suppkey, count(*) as n, max(l_returnflag) as worst from lineitem where l_shipdate > timestamp '1998-06-01' group by 1) on s_suppkey = l_suppkey
""")  # fmt: skip
def left_defaults_join(spark, d):
    late = table(spark, d, "lineitem").where("l_shipdate > timestamp '1998-06-01'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("w"))
    rows = table(spark, d, "supplier").join(late, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("late"), F.coalesce("w", F.lit("none")).alias("worst"))


@query("prefer_first_list", """
with a as (select o_custkey as k, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as k, max(o_totalprice) as v from orders where o_orderstatus = 'O' group by 1)
select k, coalesce(a.v, b.v) as v from a full join b using (k)
""")  # fmt: skip
def prefer_first_list(spark, d):
    best = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return J.either(best("F"), best("O"), ["k"], "v")


@query("best_containment_match", """
with a as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as q from benchmark),
pairs as (select item_id, doc_id, count(*) as n from (select item_id, unnest(q) as t from a) join (select doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) as t from documents) using (t) group by all),
s as (select item_id, doc_id, round(n / len(q), 6) as score from pairs join a using (item_id)),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as k from s)
select item_id, doc_id, score, case when score >= 0.75 then 'met' when score >= 0.6 then 'partly' else 'not met' end as status from r where k = 1
""")  # fmt: skip
def best_containment_match(spark, d):
    from ..functions.text import tokens

    asked = table(spark, d, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    best = J.best_containment(asked, table(spark, d, "documents").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("t")), "item_id", "q", "doc_id", "t")
    return best.withColumn("status", F.when(F.col("score") >= 0.75, "met").when(F.col("score") >= 0.6, "partly").otherwise("not met"))
